import json

import pytest

from leafscore.operators.records import KINDS, schema_checks

BOX = {"x_min": 1, "y_min": 2.5, "x_max": 30, "y_max": 40}
TOKEN = {"text": "w", "bbox": BOX, "confidence": 0.5}
SOUND = {
    "token": TOKEN,
    "recognition": {"document_id": "d", "full_text": "", "tokens": [TOKEN, {"text": "", "bbox": BOX}], "processing_time_ms": None},
    "extraction": {"document_id": "d", "fields": {}, "confidences": {"total": 1, "date": 0}, "metadata": {"a": 1}},
    "document": {"document_id": "d", "image_path": "p", "width": 3, "height": 12345678901234567890, "split": "test"},
    "experiment": {"experiment_id": "e", "document_id": "d", "degradation": {"type": "blur", "severity": 4, "seed": -1},
                   "preprocessing": {}, "ocr_model": "o", "kie_model": "k"},
}


def changed(kind, path, value):
    """A sound record with one value replaced; ``...`` takes the key away."""
    out = json.loads(json.dumps(SOUND[kind]))
    at = out
    for step in path[:-1]:
        at = at[step] if not isinstance(at, dict) or step in at else at.setdefault(step, {})
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(out)


CASES = [
    ("token", ["text"], 5, "$.text: not_a_string"), ("token", ["text"], ..., "$.text: missing"), ("token", ["text"], None, "$.text: not_a_string"),
    ("token", ["bbox"], [1, 2], "$.bbox: not_an_object"), ("token", ["bbox"], ..., "$.bbox: missing"),
    ("token", ["bbox", "x_min"], True, "$.bbox.x_min: not_a_number"), ("token", ["bbox", "y_max"], "40", "$.bbox.y_max: not_a_number"),
    ("token", ["bbox", "x_max"], ..., "$.bbox.x_max: missing"), ("token", ["bbox", "x_max"], 0, "$.bbox: inverted"),
    ("token", ["bbox", "y_min"], 41.5, "$.bbox: inverted"), ("token", ["confidence"], None, None), ("token", ["confidence"], ..., None),
    ("token", ["confidence"], True, "$.confidence: not_a_number"), ("token", ["confidence"], 1.01, "$.confidence: out_of_range"),
    ("token", ["confidence"], -0.1, "$.confidence: out_of_range"),
    ("recognition", ["document_id"], " \t", "$.document_id: blank"), ("recognition", ["document_id"], 7, "$.document_id: not_a_string"),
    ("recognition", ["full_text"], None, "$.full_text: not_a_string"), ("recognition", ["tokens"], {}, "$.tokens: not_a_list"),
    ("recognition", ["tokens", 1], 3, "$.tokens[1]: not_an_object"), ("recognition", ["tokens", 0, "bbox", "x_min"], None, "$.tokens[0].bbox.x_min: not_a_number"),
    ("recognition", ["metadata"], [], "$.metadata: not_an_object"), ("recognition", ["processing_time_ms"], -1, "$.processing_time_ms: out_of_range"),
    ("extraction", ["fields"], [], "$.fields: not_an_object"), ("extraction", ["fields"], ..., "$.fields: missing"),
    ("extraction", ["confidences", "date"], False, "$.confidences.date: not_a_number"), ("extraction", ["confidences", "total"], 2, "$.confidences.total: out_of_range"),
    ("extraction", ["confidences"], None, None), ("extraction", ["processing_time_ms"], "1", "$.processing_time_ms: not_a_number"),
    ("document", ["width"], 0, "$.width: out_of_range"), ("document", ["width"], True, "$.width: not_an_integer"), ("document", ["height"], 5.5, "$.height: not_an_integer"),
    ("document", ["height"], "5", "$.height: not_an_integer"), ("document", ["split"], "dev", "$.split: unknown_value"), ("document", ["split"], None, "$.split: not_a_string"),
    ("document", ["image_path"], "", "$.image_path: blank"),
    ("experiment", ["degradation", "severity"], 5, "$.degradation.severity: out_of_range"), ("experiment", ["degradation", "severity"], True, "$.degradation.severity: not_an_integer"),
    ("experiment", ["degradation", "seed"], 1.5, "$.degradation.seed: not_an_integer"), ("experiment", ["degradation", "type"], ..., "$.degradation.type: missing"),
    ("experiment", ["degradation"], "blur", "$.degradation: not_an_object"), ("experiment", ["preprocessing", "enabled"], 1, "$.preprocessing.enabled: not_a_boolean"),
    ("experiment", ["preprocessing", "methods"], ["a", " "], "$.preprocessing.methods[1]: blank"), ("experiment", ["preprocessing"], ..., "$.preprocessing: missing"),
    ("experiment", ["ocr_model"], "", "$.ocr_model: blank"), ("experiment", ["metrics"], 3, "$.metrics: not_an_object"),
]


@pytest.mark.parametrize("kind", list(KINDS))
def test_every_code_of_a_kind(spark, kind):
    cases = [(changed(kind, path, value), code) for k, path, value, code in CASES if k == kind]
    bodies = [json.dumps(SOUND[kind]), *[c[0] for c in cases], "{", None, "[1]", "true"]
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = {r.n: r.violations for r in schema_checks(df, kind).collect()}
    assert got[0] == []
    for n, (body, code) in enumerate(cases, start=1):
        assert got[n] == ([code] if code else []), body
    assert [got[len(cases) + k] for k in (1, 2, 3, 4)] == [["$: malformed_json"]] * 2 + [["$: not_an_object"]] * 2


def test_several_faults_come_in_rule_order(spark):
    body = json.dumps({"tokens": [{"text": 1}, TOKEN], "document_id": ""})
    row = schema_checks(spark.createDataFrame([(body,)], "body string"), "recognition").first()
    assert row.violations == ["$.document_id: blank", "$.full_text: missing", "$.tokens[0].text: not_a_string", "$.tokens[0].bbox: missing"]
