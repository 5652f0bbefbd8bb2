"""Documents read in pieces against the whole parse, with block borders at every kind of place."""

import json
import random

import pytest

from vigilake.sources import documents
from vigilake.sources.scratch import Scratch

_TEXTS = ["", "}", "{", "]}", '"', "\\", '\\"', 'a"}{"b', "é日本", "\n", '{"x":[1,{"y":"}"}]}', "Records", ',"Records":[{']


def _value(rng, depth=0):
    k = rng.randrange(7 if depth < 3 else 4)
    if k < 2:
        return rng.choice(_TEXTS) * rng.randrange(1, 4)
    if k == 2:
        return rng.choice([0, -1.5, True, None, 10**12])
    if k in (3, 4):
        return {rng.choice(_TEXTS) + str(i): _value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]


@pytest.mark.parametrize("block", [97, 1000, 1 << 20])
def test_documents_in_pieces_equal_the_whole_parse(spark, tmp_path, block):
    rng = random.Random(block)
    folder, want = tmp_path / "in", []
    folder.mkdir()
    for k in range(6):
        items = [{"n": i, "k": k, "v": _value(rng)} for i in range(rng.choice((0, 1, 40)))]
        tail = {"Other": [{"no": 1}, {"nor": "this"}], "Records2": []} if k % 3 == 0 else {}
        text = json.dumps(items if k % 2 else {"Records": items} | tail, ensure_ascii=bool(k % 4), indent=2 if k > 3 else None)
        (folder / f"{k}.json").write_text(text + ("\n" if k == 5 else ""), encoding="utf-8")
        want += items
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [json.loads(r.raw) for r in documents.read_documents(spark, str(folder), scratch=Scratch(spark, str(tmp_path / "s"))).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    key = lambda x: (x["k"], x["n"])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_a_run_over_a_document_in_pieces(spark, tmp_path):
    from vigilake.operators.detect import RuleSet
    from vigilake.plans import modes

    records = [{"eventID": f"{i:03}", "eventName": ("DeleteTrail", "Other")[i % 2], "text": '"}]'} for i in range(60)]
    (tmp_path / "log.json").write_text(json.dumps({"Records": records}))
    rules = RuleSet("intended", []).add(lambda e: [e.rule("trail", e.named("DeleteTrail"))], ("AWS.CloudTrail",))
    with Scratch(spark, str(tmp_path / "s")) as scratch:
        found = modes.once(spark, str(tmp_path / "log.json"), rules=rules, split=True, scratch=scratch)
        assert sorted(r.eventID for r in found.matches.collect()) == [f"{i:03}" for i in range(0, 60, 2)]
