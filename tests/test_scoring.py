from leafscore.operators import scoring as S
from leafscore.operators import stats as X

PAIRS = [
    (1, "company", "ABC SDN BHD", "ABC SDN BHD"), (1, "date", "01/01/2019", "02/01/2019"), (1, "address", "", "JALAN"), (1, "total", "RM 10", "10.00"),
    (2, "company", "abc sdn bhd.", "ABC SDN BHD"), (2, "date", "02/01/2019", "02/01/2019"), (2, "address", "x", ""), (2, "total", "10.00", "10.00"),
    (3, "company", None, None), (3, "date", "", ""), (3, "address", "", ""), (3, "total", " ", " "),
]
SCHEMA = "document_id int, field_name string, pred string, gt string"


def matches(spark):
    return S.field_matches(spark.createDataFrame(PAIRS, SCHEMA))


def test_field_prf(spark):
    got = {r["field_name"]: r for r in S.field_prf(matches(spark)).collect()}
    c = got["company"]
    assert (c["tp_raw"], c["fp_raw"], c["fn_raw"]) == (1, 1, 1) and c["f1_raw"] == 0.5
    assert (c["tp_normalized"], c["fp_normalized"], c["f1_normalized"]) == (2, 0, 1.0)
    assert (got["date"]["tp_raw"], got["date"]["fp_raw"], got["date"]["fn_raw"]) == (1, 1, 1)
    assert (got["address"]["tp_raw"], got["address"]["fp_raw"], got["address"]["fn_raw"]) == (0, 1, 1)
    assert got["total"]["precision_raw"] == 0.5 and got["total"]["precision_normalized"] == 1.0


def test_documents_and_entities(spark):
    docs = {r["document_id"]: r for r in S.score_fields(matches(spark)).collect()}
    assert docs[3]["raw_doc_em"] and docs[3]["normalized_doc_em"] and not docs[1]["normalized_doc_em"]
    assert docs[2]["matched_normalized"] == 3
    e = S.entity_hmean(matches(spark)).first()
    assert (e["total_gt_entities"], e["total_pred_entities"], e["total_matched_entities"]) == (7, 7, 5)
    assert e["entity_hmean"] == 0.7143


def test_empty_corpus_gives_zeros(spark):
    row = S.corpus_eval(matches(spark).where("1 = 0")).first().asDict()
    assert row["total_documents"] == 0 and all(v in (0, 0.0) for v in row.values())


def test_prediction_without_truth_is_reported(spark):
    truths = spark.createDataFrame(PAIRS, SCHEMA).select("document_id", "field_name", "gt")
    preds = spark.createDataFrame([(1, "total", "x"), (9, "total", "y")], "document_id int, field_name string, pred string")
    joined, orphans = S.pair_with_truth(preds, truths)
    assert joined.count() == 1 and [r[0] for r in orphans.select("document_id").collect()] == [9]


def test_condition_counts_states(spark):
    rows = [("a", "success"), ("a", "ocr_failed"), ("b", "ocr_failed"), ("c", "success")]
    records = spark.createDataFrame(rows, "condition_id string, status string")
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "condition_id string")
    got = {r["condition_id"]: (r["status"], r["failure_rate"]) for r in X.condition_counts(records, names).collect()}
    assert got == {"a": ("PARTIAL_FAILURE", 0.5), "b": ("ALL_FAILED", 1.0), "c": ("SUCCESS", 0.0), "d": ("EMPTY", 0.0)}


def test_single_row_group_has_no_deviation(spark):
    rows = spark.createDataFrame([("a", "success", 0.25)], "condition_id string, status string, cer double")
    r = X.condition_text_stats(rows, ["cer"]).first()
    assert (r["cer_mean"], r["cer_median"], r["cer_std"]) == (0.25, 0.25, 0.0)


def test_any_white_space_is_blank(spark):
    """Tabs, line ends and no-break spaces alone are neither a prediction nor a reference."""
    rows = [(1, "company", "\t\n", "x"), (2, "company", "x", "\u00a0"), (3, "date", "\x1f", "\u00a0"), (4, "date", "a", "a")]
    matches = S.field_matches(spark.createDataFrame(rows, "document_id int, field_name string, pred string, gt string"))
    got = {r.document_id: (r.has_pred_raw, r.has_gt_raw, r.has_pred_normalized, r.has_gt_normalized) for r in matches.collect()}
    assert got == {1: (False, True, False, True), 2: (True, False, True, False), 3: (False,) * 4, 4: (True,) * 4}
    prf = {r.field_name: (r.precision_raw, r.recall_raw) for r in S.field_prf(matches).collect()}
    assert prf == {"company": (0.0, 0.0), "date": (1.0, 1.0)}


def test_words_shared_by_raw_and_normalized_texts_are_measured_once_and_right(spark):
    rows = [("a  b\nc", "a b d"), ("x\u200by z", "xy z"), ("e\u0301 b", "\u00e9 b"), ("", "a"), (None, None)]
    got = S.score_text(spark.createDataFrame(rows, "pred string, gt string")).select("wer_raw", "wer_normalized").collect()
    assert [tuple(r) for r in got] == [(0.3333, 0.3333), (0.5, 0.0), (0.5, 0.0), (1.0, 1.0), (0.0, 0.0)]
