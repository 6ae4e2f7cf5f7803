"""Layout helpers: parts of a scan, and columns that are computed once per row."""

from pyspark.sql import functions as F

from leafscore.operators.extraction import company_candidates
from leafscore.operators.layout import bound, spread
from leafscore.operators.scoring import field_matches


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spread_deals_many_splits_into_parts(spark):
    scan = spark.range(0, 1000, 1, 50)
    assert spread(scan, "id").rdd.getNumPartitions() == 50
    assert spread(scan, "id", parts=8).rdd.getNumPartitions() == 400
    assert spread(scan.coalesce(1), "id", parts=8).rdd.getNumPartitions() == 16


def test_bound_columns_are_computed_once(spark):
    df = spark.createDataFrame([(1, " a "), (2, None), (3, "")], "id int, `t x` string")
    assert [tuple(r) for r in bound(df, u=F.upper("t x")).orderBy("id").collect()] == [(1, " a ", " A "), (2, None, None), (3, "", "")]
    assert sorted(map(tuple, bound(df).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    long = bound(df, u=F.regexp_replace("t x", "a+", "b")).where("length(u) > 1 AND u <> 'x' AND u LIKE '%b%'")
    assert plan(long).count("regexp_replace(") == 1


def test_candidates_strip_each_token_once(spark):
    tokens = spark.createDataFrame([(1, 0, " ACME SDN BHD "), (1, 1, "TAX INVOICE"), (1, 2, "12345"), (1, 3, None)], "document_id long, idx int, text string")
    found = company_candidates(tokens)
    assert [(r["idx"], r["value"], r["confidence"]) for r in found.collect()] == [(0, "ACME SDN BHD", 1.0)]
    assert plan(found).count("regexp_replace(") == 1


def test_field_matches_flags(spark):
    rows = [(1, "company", "  ", "x"), (2, "total", "RM 5", "5.00"), (3, "company", None, ""), (4, "address", "Café,", "café"), (5, None, "A", "a")]
    out = field_matches(spark.createDataFrame(rows, "document_id long, field_name string, pred string, gt string"))
    got = {r["document_id"]: r for r in out.collect()}
    assert [got[k]["match_normalized"] for k in range(1, 6)] == [False, True, True, True, True]
    assert [got[k]["has_pred_raw"] for k in range(1, 6)] == [False, True, False, True, True]
    assert (got[4]["pred_normalized"], got[2]["gt_normalized"], got[3]["pred_raw"]) == ("café", "5.00", "")
    assert plan(out.groupBy().agg(F.count_if("match_normalized"), F.count_if(F.col("match_normalized") & F.col("has_pred_normalized")))).count("rpad(") == 2


def test_texts_are_normalized_once_before_their_distances(spark):
    from leafscore.operators import matrix, robustness
    from leafscore.operators.compare import run_compare
    from leafscore.operators.scoring import score_text

    two = spark.createDataFrame([(1, "a", "b", 1, 2)], "document_id int, text_a string, text_b string, tokens_a int, tokens_b int")
    docs = two.select("document_id", F.col("text_a").alias("text"))
    names = spark.createDataFrame([("rotation", 1, "none")], "d string, s int, p string")
    conditions = matrix.condition_matrix(names.select("d"), names.select("s"), names.select("p"))
    for out in (
        run_compare(two), score_text(two, "text_a", "text_b"), robustness.robustness_records(docs, conditions),
    ):
        assert plan(out).count(r"[\p{C}&&[^\n\r\t]]") == 2  # one for either side


def test_box_lines_are_split_once(spark):
    from leafscore.operators.audit import parse_box_lines

    good, bom = "1,2,3,4,5,6,7,8,A, B", "\ufeff1,2,3,4,5,6,7,8,C\r\n"
    lines = [good, bom, "1,2,x,4,5,6,7,8,T", "1,2,3,T", " \n", None, "1,2,3,4,5,6,7,inf,T", "1,2,3,4,5,6,7,8,9,10,T"]
    out = parse_box_lines(spark.createDataFrame(list(enumerate(lines)), "id int, line string"))
    assert plan(out).count("regexp_replace(") == 1
    assert [(r["id"], r["reason"], r["transcript"], r["x_max"]) for r in out.orderBy("id").collect()] == [
        (0, None, "A, B", 7.0), (1, None, "C", 7.0), (2, "non_numeric", None, None), (3, "too_few_parts", None, None),
        (6, "non_finite", None, None), (7, "extra_coordinates", None, None)]
