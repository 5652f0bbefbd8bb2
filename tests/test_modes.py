"""Whole runs: raw lines of many formats through all packs, by packs and at once."""

import json

from pyspark.sql import functions as F

from tests.oracle import compare
from vigilake.functions import aws
from vigilake.operators.classify import classify
from vigilake.operators.detect import RuleSet, analyze, analyze_by_pack
from vigilake.plans import catalog, modes, queries_packs
from vigilake.sources.scratch import Scratch


def test_all_packs_over_lines_of_many_formats(spark, small):
    compare(spark, small, catalog.queries()["once_all_packs"], catalog.oracle_sql()["once_all_packs"])


def test_packs_apart_and_at_once_agree(spark, small, tmp_path):
    events = classify(queries_packs.attack_lines(spark, small))
    packs = ["okta", "slack_audit", "gsuite"]
    with Scratch(spark, str(tmp_path / "run")) as scratch:
        apart = analyze_by_pack(events, RuleSet("intended", packs), scratch=scratch)
        whole = analyze(events, RuleSet("intended", packs))
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(apart.matches.select(*whole.matches.columns)) == rows(whole.matches) and apart.matches.count()
        present = {"okta": "okta_", "slack_audit": "slack_", "gsuite": "gsuite_"}
        assert [tuple(r) for r in apart.evaluations.collect()] == [tuple(r) for r in whole.evaluations.collect()] and present
    assert not (tmp_path / "run").exists()


def test_the_smallest_run(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    root = {"eventID": "1", "eventTime": "2024-01-01T00:00:00Z", "eventName": "ConsoleLogin", "eventSource": "signin.amazonaws.com", "userIdentity": {"type": "Root"}, "responseElements": {"ConsoleLogin": "Success"}}
    path.write_text(json.dumps(root) + "\nnothing known\n")
    rules = RuleSet("intended", []).add(lambda e: [e.rule("root_login", e.eq("userIdentity.type", "Root") & e.named("ConsoleLogin"), "Root", "HIGH")], ("AWS.CloudTrail",)).add(lambda e: [e.rule("any", F.lit(True))])
    found = modes.once(spark, str(path), rules=rules)
    assert sorted(r.rule_id for r in found.matches.collect()) == ["any", "root_login"]
    assert [tuple(r) for r in found.evaluations.collect()] == [("any", 1, 0), ("root_login", 1, 0)]
    assert modes.once(spark, str(path), rules=RuleSet("intended", ["okta"])).matches.count() == 0


def test_iam_actions_that_expose_resources(spark):
    names = "UpdateAccountName CreateDelegationRequest EnableOrganizationsRootSessions DeleteCloudFrontPublicKey CreateUser PassRole UploadSSHPublicKey GetUser".split()
    df = spark.createDataFrame([(f"iam:{n}",) for n in names], "a string")
    assert [r.x for r in df.select(aws.exposes_resources(F.col("a")).alias("x")).collect()] == [False] * 4 + [True] * 3 + [False]
    assert len(aws.RESOURCE_EXPOSURE_IAM) == len(set(aws.RESOURCE_EXPOSURE_IAM)) == 79
