"""Queries of the pipeline language, parsers, sources and stateful operators over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import ids, net, text
from vigilake.operators import alerts, stateful
from vigilake.operators.classify import classifier_stats, parse_as, service_type
from vigilake.operators.conditions import condition
from vigilake.operators.dsl import cnd, rule, tf
from vigilake.operators.pipeline import Pipeline
from vigilake.sources import lake, ledger, notifications
from vigilake.sources.scratch import Scratch
from vigilake.streaming import metrics

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``data``, each as a JSON message."""
    e = load(spark, sf_dir, "events")
    props = F.from_json("props", "k long")
    return e.withColumn("data", F.to_json(F.struct("event_id", "user_id", "event_type", "value", props.alias("props"))))


# ---- conditions ----


def _conditions() -> None:
    k = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    cases = {
        "cond_string_equals": (cnd.equals("event_type", "error"), "event_type = 'error'"),
        "cond_string_contains": (cnd.contains("event_type", "ur"), "contains(event_type, 'ur')"),
        "cond_string_starts_with": (cnd.starts_with("event_type", "c"), "starts_with(event_type, 'c')"),
        "cond_string_ends_with": (cnd.ends_with("event_type", "p"), "suffix(event_type, 'p')"),
        "cond_string_match": (cnd.match("event_type", "^(s|v).*[pw]$"), "regexp_matches(event_type, '^(s|v).*[pw]$')"),
        "cond_number_equals": (cnd.eq("props.k", 42), f"{k} = 42"),
        "cond_number_greater_than": (cnd.gt("value", 50), "value > 50"),
        "cond_number_less_than": (cnd.lt("props.k", 10), f"{k} < 10"),
        "cond_all": (cnd.all(cnd.equals("event_type", "view"), cnd.gt("props.k", 50)), f"event_type = 'view' AND {k} > 50"),
        "cond_any": (cnd.any(cnd.equals("event_type", "view"), cnd.equals("event_type", "click")), "event_type IN ('view', 'click')"),
        "cond_none": (cnd.none(cnd.equals("event_type", "view"), cnd.gt("value", 10)), "NOT (event_type = 'view' OR value > 10)"),
        "cond_exists": (cnd.all(cnd.exists("props.k"), cnd.none(cnd.exists("props.other"))), "json_extract_string(props, '$.k') IS NOT NULL"),
        "cond_format_json": (cnd.format_json(), "json_valid(props)"),
    }
    for name, (config, where) in cases.items():
        def run(spark, sf_dir, config=config):
            return event_rows(spark, sf_dir).where(condition(config)).select("event_id")

        QUERIES[name] = (run, f"SELECT event_id FROM events WHERE {where}")


_conditions()

# ---- transforms ----


def _transform(name: str, transforms: list[dict], outputs: dict[str, str], sql: str) -> None:
    def run(spark, sf_dir):
        done = Pipeline(transforms).run(event_rows(spark, sf_dir).select("event_id", "data")).messages
        return done.select("event_id", *(F.get_json_object("data", path).alias(n) for n, path in outputs.items()))

    QUERIES[name] = (run, sql)


_transform("tf_object_copy", [tf.copy("props.k", "copied.k")], {"copied": "$.copied.k"}, "SELECT event_id, json_extract_string(props, '$.k') AS copied FROM events")
_transform("tf_object_insert", [tf.insert("tag", {"a": [1, "x"]})], {"tag": "$.tag", "event_type": "$.event_type"}, """SELECT event_id, '{"a":[1,"x"]}' AS tag, event_type FROM events""")
_transform("tf_object_delete", [tf.delete("props")], {"props": "$.props", "event_type": "$.event_type"}, "SELECT event_id, CAST(NULL AS VARCHAR) AS props, event_type FROM events")
_transform("tf_string_upper", [tf.upper("event_type", "up")], {"up": "$.up"}, "SELECT event_id, upper(event_type) AS up FROM events")
_transform("tf_string_lower", [tf.upper("event_type"), tf.lower("event_type", "low")], {"low": "$.low", "event_type": "$.event_type"}, "SELECT event_id, event_type AS low, upper(event_type) AS event_type FROM events")
_transform("tf_string_replace", [tf.replace("event_type", "i", ".")], {"event_type": "$.event_type"}, "SELECT event_id, replace(event_type, 'i', '.') AS event_type FROM events")
_transform(
    "tf_meta_switch",
    [tf.switch((cnd.equals("event_type", "error"), [tf.insert("route", "errors")]), (cnd.gt("value", 50), [tf.insert("route", "large")]), (cnd.equals("event_type", "view"), [tf.drop()]), (None, [tf.insert("route", "rest")]))],
    {"route": "$.route"},
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 'errors' WHEN value > 50 THEN 'large' ELSE 'rest' END AS route FROM events WHERE event_type = 'error' OR value > 50 OR event_type <> 'view'",
)


@query("SELECT conv_id, turn, upper(role) AS role FROM conversations")
def tf_meta_for_each(spark, sf_dir):
    turns = F.struct("conv_id", "turn", "role")
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(turns).alias("turns")).select(F.to_json(F.struct("turns")).alias("data"))
    done = Pipeline([tf.for_each("turns", tf.upper("role"))]).run(c).messages
    return done.select(F.get_json_object("data", "$.conv_id").cast("long").alias("conv_id"), F.get_json_object("data", "$.turn").cast("long").alias("turn"), F.get_json_object("data", "$.role").alias("role"))


_RULES = [
    tf.detect("large", cnd.gt("value", 50), title="Large value", severity="LOW", dedup_key="user_id"),
    tf.detect("failure", cnd.equals("event_type", "error"), title="Failure", severity="HIGH", dedup_key="event_type"),
]


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'large' END AS rule_id, CASE WHEN event_type = 'error' THEN 'HIGH' ELSE 'LOW' END AS severity, CASE WHEN event_type = 'error' THEN 'error' ELSE CAST(user_id AS VARCHAR) END AS dedup_key FROM events WHERE event_type = 'error' OR value > 50")
def tf_detect_last_wins(spark, sf_dir):
    done = Pipeline(_RULES).run(event_rows(spark, sf_dir).select("event_id", "data")).messages.where("alert is not null")
    return done.select("event_id", *(F.get_json_object("alert", f"$.{n}").alias(n) for n in ("rule_id", "severity", "dedup_key")))


@query("SELECT 'stdout' AS sink, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'large' END AS rule_id, count(*) AS n FROM events WHERE event_type = 'error' OR value > 50 GROUP BY 1, 2")
def tf_alert_outputs(spark, sf_dir):
    out = Pipeline([*_RULES, tf.alert(tf.stdout()), tf.drop()]).run(event_rows(spark, sf_dir).select("data")).outbox
    return out.groupBy("sink", F.get_json_object("payload", "$.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'large_purchase' AS rule_id, 'HIGH' AS severity, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'purchase' AND value > 50 HAVING count(*) > 0")
def detect_large_purchases(spark, sf_dir):
    """The flagship: messages, a rule of two conditions, its alerts by rule and severity."""
    config = rule("large_purchase", cnd.all(cnd.equals("event_type", "purchase"), cnd.gt("value", 50)), [tf.stdout()], severity="HIGH", title="Large purchase", dedup_key="user_id")
    out = Pipeline(config).run(event_rows(spark, sf_dir).select("data")).outbox
    field = lambda n: F.get_json_object("payload", f"$.{n}").alias(n)
    return out.select(field("rule_id"), field("severity"), field("dedup_key")).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dedup_key").alias("users"))


@query("SELECT c_custkey, n_name AS host FROM customer JOIN nation ON n_nationkey = c_nationkey")
def tf_enrich_lookup(spark, sf_dir):
    names = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit(".")))
    c = load(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_nationkey").cast("string").alias("ip"))).alias("data"))
    done = Pipeline([tf.dns_reverse("ip")], resolve={"dns_reverse": names}).run(c).messages
    return done.select("c_custkey", F.get_json_object("data", "$.ip_hostname").alias("host"))


_IP = "CASE user_id % 5 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '192.168.7.' WHEN 2 THEN '8.8.4.' WHEN 3 THEN '127.0.0.' ELSE '172.20.1.' END || CAST(user_id % 250 AS {t})"


def _ip() -> Column:
    return F.expr(_IP.format(t="STRING"))


@query("SELECT event_id, user_id % 5 IN (0, 1, 4) AS is_private, user_id % 5 = 3 AS is_loopback, user_id % 5 = 2 AS is_global FROM events")
def tf_geo_flags(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(_ip().alias("ip"))).alias("data"))
    done = Pipeline([tf.geoip("ip")]).run(e).messages
    return done.select("event_id", *(F.get_json_object("data", f"$.ip_geo.{n}").cast("boolean").alias(n) for n in ("is_private", "is_loopback", "is_global")))


# ---- parsers ----

_TIME = "date_format(timestamp_seconds({s}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def _seconds() -> Column:
    """Whole seconds of an event's time."""
    return F.expr("CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT)")


_SQL_SECONDS = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"
_SQL_STAMP = "strftime(ts, '%Y%m%d%H%M%S')"


def _iso() -> Column:
    return F.date_format(F.timestamp_seconds(_seconds()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


@query(f"SELECT CAST(event_id AS VARCHAR) AS event_id, {_SQL_SECONDS} AS at, event_type AS name, 'IAMUser' AS who, CAST(user_id AS VARCHAR) AS principal, value AS v FROM events")
def parse_cloudtrail_roundtrip(spark, sf_dir):
    who = F.struct(F.lit("IAMUser").alias("type"), F.col("user_id").cast("string").alias("principalId"))
    raw = F.to_json(F.struct(F.col("event_id").cast("string").alias("eventID"), _iso().alias("eventTime"), F.col("event_type").alias("eventName"), who.alias("userIdentity"), F.struct("value").alias("requestParameters")))
    p = parse_as(load(spark, sf_dir, "events").select(raw.alias("raw")), "AWS.CloudTrail")
    return p.select(F.col("eventID").alias("event_id"), F.unix_seconds("eventTime").alias("at"), F.col("eventName").alias("name"), F.col("userIdentity.type").alias("who"), F.col("userIdentity.principalId").alias("principal"), F.try_variant_get("requestParameters", "$.value", "double").alias("v"))


@query(f"SELECT 'vpcflow-eni-' || CAST(user_id AS VARCHAR) || '-' || strftime(to_timestamp({_SQL_SECONDS} + 60) AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') AS event_id, '10.0.0.1' AS source, user_id AS port, event_id AS bytes, {_SQL_SECONDS} + 60 AS at FROM events")
def parse_vpcflow(spark, sf_dir):
    raw = F.concat_ws(" ", F.lit("2 123456789010"), F.concat(F.lit("eni-"), F.col("user_id").cast("string")), F.lit("10.0.0.1 10.0.0.2 443"), F.col("user_id").cast("string"), F.lit("6 20"), F.col("event_id").cast("string"), _seconds().cast("string"), (_seconds() + 60).cast("string"), F.lit("ACCEPT OK"))
    p = parse_as(load(spark, sf_dir, "events").select(raw.alias("raw")), "AWS.VPCFlow")
    n = lambda path: F.try_variant_get("requestParameters", f"$.{path}", "bigint")
    return p.select(F.col("eventID").alias("event_id"), F.col("sourceIPAddress").alias("source"), n("dstPort").alias("port"), n("bytes").alias("bytes"), F.unix_seconds("eventTime").alias("at"))


@query(f"SELECT 'alb-app/lb-' || event_type || '-' || {_SQL_STAMP} AS event_id, 'ALB-GET' AS name, '192.0.2.7' AS client, CAST(2817 AS BIGINT) AS client_port, 'https://x.example:443/a b?id=' || CAST(event_id AS VARCHAR) AS url, CAST(200 + user_id % 300 AS BIGINT) AS status, 0.086 AS took, 'Agent of ' || event_type AS agent FROM events")
def parse_alb(spark, sf_dir):
    raw = F.concat(
        F.lit("https "), _iso(), F.lit(" app/lb-"), F.col("event_type"), F.lit(" 192.0.2.7:2817 10.0.0.1:80 0.086 0.048 - "), (200 + F.col("user_id") % 300).cast("string"), F.lit(' 200 0 57 "GET https://x.example:443/a b?id='),
        F.col("event_id").cast("string"), F.lit(' HTTP/1.1" "Agent of '), F.col("event_type"), F.lit('" ECDHE TLSv1.2 arn:tg "Root=1" "x.example" "arn:cert" 1 '), _iso(), F.lit(' "forward,log" "-" "-" "10.0.0.1:80" "200"'),
    )
    p = parse_as(load(spark, sf_dir, "events").select(raw.alias("raw")), "AWS.ALB")
    v = lambda path, kind: F.try_variant_get("requestParameters", f"$.{path}", kind)
    return p.select(F.col("eventID").alias("event_id"), F.col("eventName").alias("name"), F.col("sourceIPAddress").alias("client"), v("clientPort", "bigint").alias("client_port"), v("requestUrl", "string").alias("url"), v("elbStatusCode", "bigint").alias("status"), v("requestProcessingTime", "double").alias("took"), v("userAgent", "string").alias("agent"))


@query(f"SELECT 's3-R' || CAST(event_id AS VARCHAR) || '-' || {_SQL_STAMP} AS event_id, 'REST.GET.OBJECT' AS name, CAST(200 + user_id % 300 AS BIGINT) AS status, 'key ' || event_type AS uri, CAST(NULL AS VARCHAR) AS error FROM events")
def parse_s3access(spark, sf_dir):
    when = F.date_format(F.timestamp_seconds(_seconds()), "dd/MMM/yyyy:HH:mm:ss")
    raw = F.concat(
        F.lit("owner bucket ["), when, F.lit(" +0000] 192.0.2.3 - R"), F.col("event_id").cast("string"), F.lit(' REST.GET.OBJECT a/b "key '), F.col("event_type"), F.lit('" '), (200 + F.col("user_id") % 300).cast("string"),
        F.lit(' - 113 - 7 - "-" "Console/0.4" - host= SigV4 ECDHE AuthHeader h.s3 TLSV1.2'),
    )
    p = parse_as(load(spark, sf_dir, "events").select(raw.alias("raw")), "AWS.S3ServerAccess")
    v = lambda path, kind: F.try_variant_get("requestParameters", f"$.{path}", kind)
    return p.select(F.col("eventID").alias("event_id"), F.col("eventName").alias("name"), v("httpStatus", "bigint").alias("status"), v("requestURI", "string").alias("uri"), v("errorCode", "string").alias("error"))


@query("SELECT epoch_us(ts) AS at, 'AuroraMySQL-QUERY' AS name, user_id AS connection, 'select a, ' || event_type AS object, CAST(user_id % 3 AS BIGINT) AS code FROM events")
def parse_aurora(spark, sf_dir):
    raw = F.concat(F.expr("CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS STRING)"), F.lit(",db-1,admin,10.0.0.5,"), F.col("user_id").cast("string"), F.lit(",99,QUERY,mydb,select a, "), F.col("event_type"), F.lit(","), (F.col("user_id") % 3).cast("string"))
    p = parse_as(load(spark, sf_dir, "events").select(raw.alias("raw")), "AWS.AuroraMySQLAudit")
    v = lambda path, kind: F.try_variant_get("requestParameters", f"$.{path}", kind)
    return p.select(F.unix_micros("eventTime").alias("at"), F.col("eventName").alias("name"), v("connectionId", "bigint").alias("connection"), v("object", "string").alias("object"), v("retCode", "bigint").alias("code"))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of several formats, one in eight of none."""
    e = load(spark, sf_dir, "events")
    ident = F.col("event_id").cast("string")
    js = lambda **c: F.to_json(F.struct(*(x.alias(n) for n, x in c.items())))
    forms = [
        js(eventID=ident, eventName=F.col("event_type"), eventTime=_iso()),
        js(uuid=ident, published=_iso(), eventType=F.col("event_type")),
        js(action=F.col("event_type"), created_at=_seconds() * 1000, actor=F.lit("a")),
        js(kind=F.lit("Event"), apiVersion=F.lit("audit.k8s.io/v1"), auditID=ident, verb=F.lit("get")),
        js(Kind=F.lit("firewall"), RayID=ident, Action=F.lit("block")),
        F.concat(_seconds().cast("string"), F.lit("000000,db,u,h,1,2,QUERY,d,o,0")),
        js(protoPayload=F.struct(F.lit("x.y").alias("methodName")), insertId=ident),
        F.concat(F.lit("nothing known "), ident),
    ]
    pick = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        pick = F.when(F.col("event_id") % 8 == i, form).otherwise(pick)
    return e.select("event_id", pick.alias("raw"))


@query("SELECT CASE event_id % 8 WHEN 0 THEN 'AWS.CloudTrail' WHEN 1 THEN 'Okta.SystemLog' WHEN 2 THEN 'GitHub.Audit' WHEN 3 THEN 'Amazon.EKS.Audit' WHEN 4 THEN 'Cloudflare.Firewall' WHEN 5 THEN 'AWS.AuroraMySQLAudit' WHEN 6 THEN 'GCP.AuditLog' ELSE 'unclassified' END AS log_type, count(*) AS records FROM events GROUP BY 1")
def classify_mixed(spark, sf_dir):
    return classifier_stats(mixed_lines(spark, sf_dir)).select("log_type", "records")


@query("SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'AWS.IAM' WHEN 1 THEN 'AWS.S3' WHEN 2 THEN 'AWS.EC2' ELSE 'AWS.CloudTrail' END AS service FROM events")
def classify_service(spark, sf_dir):
    source = F.expr("CASE user_id % 4 WHEN 0 THEN 'iam.amazonaws.com' WHEN 1 THEN 's3.eu-west-1.amazonaws.com' WHEN 2 THEN 'ec2.amazonaws.com' ELSE 'sqs.amazonaws.com' END")
    return load(spark, sf_dir, "events").select("event_id", service_type(source).alias("service"))


# ---- sources ----


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Okta.SystemLog' WHEN 'view' THEN 'AWS.CloudTrail' WHEN 'error' THEN 'GSuite.Reports' ELSE '' END AS hint, user_id AS u FROM events")
def eventbridge_unwrap(spark, sf_dir):
    source = F.expr("CASE event_type WHEN 'click' THEN 'aws.partner/okta.com' WHEN 'view' THEN 'aws.signin' WHEN 'error' THEN 'google.workspace' ELSE 'other' END")
    kind = F.expr("CASE event_type WHEN 'view' THEN 'AWS Console Sign In via CloudTrail' ELSE 'x' END")
    body = F.to_json(F.struct(source.alias("source"), kind.alias("detail-type"), F.struct("event_id", "user_id").alias("detail")))
    out = notifications.unwrap_envelopes(load(spark, sf_dir, "events").select(body.alias("body")))
    return out.select(F.get_json_object("raw", "$.event_id").cast("long").alias("event_id"), "hint", F.get_json_object("raw", "$.user_id").cast("long").alias("u"))


@query("SELECT event_id, n FROM events, (VALUES (0), (1), (2)) AS t(n) WHERE event_id % 3 < 2 OR n = 0")
def batched_split(spark, sf_dir):
    item = lambda i: F.struct("event_id", F.lit(i).alias("n"))
    three = F.array(item(0), item(1), item(2))
    raw = F.when(F.col("event_id") % 3 == 0, F.to_json(three)).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(three.alias("events")))).otherwise(F.to_json(item(0)))
    out = notifications.split_batches(load(spark, sf_dir, "events").select(raw.alias("raw")))
    return out.select(F.get_json_object("raw", "$.event_id").cast("long").alias("event_id"), F.get_json_object("raw", "$.n").cast("int").alias("n"))


@query("SELECT 'b' || CAST(user_id AS VARCHAR) AS bucket, 'k/' || CAST(event_id AS VARCHAR) AS key FROM events WHERE event_type IN ('click', 'view')")
def s3_notification(spark, sf_dir):
    name = F.expr("CASE event_type WHEN 'click' THEN 'ObjectCreated:Put' WHEN 'view' THEN 'ObjectCreated:CompleteMultipartUpload' ELSE 'ObjectRemoved:Delete' END")
    s3 = F.struct(F.struct(F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("name")).alias("bucket"), F.struct(F.concat(F.lit("k/"), F.col("event_id").cast("string")).alias("key")).alias("object"))
    records = F.to_json(F.struct(F.array(F.struct(name.alias("eventName"), s3.alias("s3"))).alias("Records")))
    body = F.when(F.col("event_id") % 2 == 0, records).otherwise(F.to_json(F.struct(F.lit("Notification").alias("Type"), records.alias("Message"))))
    return notifications.s3_objects(load(spark, sf_dir, "events").select(body.alias("body"))).select("bucket", "key")


@query("SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 12, '0') AS account, event_type AS region FROM events WHERE event_id % 2 = 0")
def s3_key_accounts(spark, sf_dir):
    account = F.lpad(F.col("user_id").cast("string"), 12, "0")
    name = F.concat(account, F.lit("_CloudTrail_"), F.col("event_type"), F.lit("_20240101T0000Z_abc.json.gz"))
    key = F.concat(F.when(F.col("event_id") % 4 == 0, "AWSLogs/o-abc/").otherwise("AWSLogs/"), account, F.when(F.col("event_id") % 2 == 0, "/CloudTrail/").otherwise("/Config/"), F.col("event_type"), F.lit("/2024/01/01/"), name)
    return ledger.account_regions(load(spark, sf_dir, "events").select(key.alias("key")))


@query("SELECT event_id FROM events WHERE event_type <> 'click'")
def ledger_unprocessed(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "event_type", F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("etag"))
    return ledger.unprocessed(e, e.where("event_type = 'click'").select("key", "etag")).select("event_id")


# ---- lake ----


def _events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("eventTime", F.col("ts").cast("timestamp"))
    return lake.with_hours(e).withColumns({c: F.col(c).cast("int") for c in lake.PARTITIONS})


@query("SELECT CAST(date_part('year', ts) AS INTEGER) AS year, CAST(date_part('month', ts) AS INTEGER) AS month, CAST(date_part('day', ts) AS INTEGER) AS day, CAST(date_part('hour', ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY ALL")
def lake_hour_partitions(spark, sf_dir):
    return _events_by_hour(spark, sf_dir).groupBy(*lake.PARTITIONS).agg(F.count(F.lit(1)).alias("n"))


_FROM, _TO = datetime(2024, 1, 5, 10, 20), datetime(2024, 1, 8, 3, 30)


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 10:00:00' AND ts < TIMESTAMP '2024-01-08 04:00:00'")
def lake_query_range(spark, sf_dir):
    return lake.in_range(_events_by_hour(spark, sf_dir), _FROM, _TO).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 10:20:00' AND ts < TIMESTAMP '2024-01-08 03:30:00'")
def lake_exact_range(spark, sf_dir):
    return lake.in_range(_events_by_hour(spark, sf_dir), _FROM, _TO, exact=True).select("event_id")


# ---- stateful ----


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("us", stateful.micros(F.col("ts")))


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 86400000001 PRECEDING) AS n
FROM (SELECT *, epoch_us(ts) AS us FROM events) e) x WHERE n = 3""")
def window_threshold(spark, sf_dir):
    return stateful.threshold_crossed(_timed(spark, sf_dir), ["user_id"], "us", ["event_id"], 86_400_000_000, 3).select("event_id", "user_id")


@query("""SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY us, event_id) - CASE WHEN event_type = 'click'
THEN count(*) OVER (PARTITION BY event_type, user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 86400000001 PRECEDING)
ELSE count(*) OVER (PARTITION BY event_type, user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 172800000001 PRECEDING) END AS n
FROM (SELECT *, epoch_us(ts) AS us FROM events WHERE event_type IN ('click', 'view')) e) x WHERE n = CASE WHEN event_type = 'click' THEN 2 ELSE 3 END""")
def window_thresholds_by_rule(spark, sf_dir):
    limits = {"click": (86_400_000_000, 2), "view": (172_800_000_000, 3)}
    e = _timed(spark, sf_dir).where(F.col("event_type").isin(*limits))
    return stateful.thresholds_crossed(e, limits, "event_type", "user_id", "us", ["event_id"]).select("event_id", "event_type")


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS r FROM events) x WHERE r = 1")
def first_seen(spark, sf_dir):
    return stateful.first_seen(load(spark, sf_dir, "events"), ["event_type", "user_id"], ["ts", "event_id"]).select("event_type", "user_id", "event_id")


@query("SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS event_key FROM events")
def event_dedup(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("event_key"))
    return stateful.dedup_events(e, ("event_type", "event_key"))


_FOLD = """WITH RECURSIVE e AS (SELECT user_id AS k, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
r(k, c) AS (SELECT k, min(t) FROM e GROUP BY k UNION ALL SELECT r.k, (SELECT min(t) FROM e WHERE e.k = r.k AND e.t > r.c + 86400000000) FROM r WHERE (SELECT min(t) FROM e WHERE e.k = r.k AND e.t > r.c + 86400000000) IS NOT NULL)
"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.lit("errors").alias("rule_id"), F.col("user_id").cast("string").alias("dedup"), F.lit("Error").alias("title"), F.lit("HIGH").alias("severity"), F.col("ts").cast("timestamp").alias("event_time"))


@query(_FOLD + "SELECT CAST(r.k AS VARCHAR) AS dedup, r.c AS created, max(e.t) AS updated, count(*) AS hits FROM r JOIN e ON e.k = r.k AND e.t BETWEEN r.c AND r.c + 86400000000 GROUP BY r.k, r.c")
def alert_dedup_fold(spark, sf_dir):
    runs = stateful.alert_runs(_errors(spark, sf_dir), period_minutes=1440)
    return runs.select("dedup", F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated"), "hits")


@query(QUERIES["alert_dedup_fold"][1])
def alert_dedup_in_parts(spark, sf_dir):
    """The same with every key dealt over many tasks, as keys are that hold too many matches for one."""
    runs = stateful.alert_runs(_errors(spark, sf_dir), period_minutes=1440, hot_rows=0, scratch=Scratch(spark))
    return runs.select("dedup", F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated"), "hits")


@query(_FOLD + ", a AS (SELECT r.k, r.c, max(e.t) AS u, max(r.c) OVER (PARTITION BY r.k) AS last FROM r JOIN e ON e.k = r.k AND e.t BETWEEN r.c AND r.c + 86400000000 GROUP BY r.k, r.c) SELECT CAST(k AS VARCHAR) AS dedup, c AS created, u AS updated FROM a WHERE c = last ORDER BY u DESC, k LIMIT 20 OFFSET 5")
def open_alerts_page(spark, sf_dir):
    runs = stateful.alert_runs(_errors(spark, sf_dir), period_minutes=1440)
    return stateful.open_alerts(runs, limit=20, offset=5).select("dedup", F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated"))


_H = "sha1(unhex('a3bb189e8bf938889912ace4e6543002') || encode('rule:' || event_type || CAST(user_id AS VARCHAR)))"


@query(f"SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS key FROM (SELECT event_id, {_H} AS h FROM events) x")
def uuid5_dedup_key(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", ids.dedup_key(F.lit("rule"), F.concat("event_type", F.col("user_id").cast("string"))).alias("key"))


# ---- scalar functions ----


@query("SELECT event_id, user_id % 5 = 2 AS is_global, user_id % 5 <> 2 AS is_private, user_id % 5 = 3 AS is_loopback FROM events")
def helper_ip_tests(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", net.is_global(_ip()).alias("is_global"), net.is_private(_ip()).alias("is_private"), net.is_loopback(_ip()).alias("is_loopback"))


@query("SELECT p_partkey, contains(lower(p_name), 'a') OR contains(lower(p_name), 'x1') AS some FROM part")
def helper_pattern_match(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.contains_any_ci(F.col("p_name"), ["A", "X1"]).alias("some"))


@query("SELECT p_partkey, regexp_matches(p_brand, '^Brand#1.$') OR regexp_matches(p_brand, '^.*5$') AS hit FROM part")
def helper_glob(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.matches_glob(F.col("p_brand"), ["Brand#1?", "*5"]).alias("hit"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS t, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN NULL ELSE user_id END AS n FROM events")
def helper_csv_scalars(spark, sf_dir):
    t = F.when(F.col("event_type") == "view", " - ").otherwise(F.concat(F.lit("  "), F.col("event_type")))
    n = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", "12x").otherwise(F.col("user_id").cast("string"))
    return load(spark, sf_dir, "events").select("event_id", text.blank_to_null(t).alias("t"), text.to_int(n).alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) > 150 THEN left(text, 149) || '…' ELSE text END AS short, replace(replace(replace(left(text, 60), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM documents")
def helper_slack_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 150).alias("short"), text.slack_escaped(F.substring("text", 1, 60)).alias("safe"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM documents")
def helper_slack_text_whole(spark, sf_dir):
    """The escaping over whole texts; helper_slack_text compares their first 60 characters."""
    return load(spark, sf_dir, "documents").select("doc_id", text.slack_escaped(F.col("text")).alias("safe"))


# ---- aggregates and metrics ----


@query("SELECT event_type AS severity, CAST(user_id % 7 AS VARCHAR) AS rule_id, count(*) AS n FROM events GROUP BY 1, 2")
def alert_counts(spark, sf_dir):
    return alerts.counts(load(spark, sf_dir, "events").select(F.col("event_type").alias("severity"), (F.col("user_id") % 7).cast("string").alias("rule_id")))


@query("SELECT min(epoch_us(ts)) AS first_event, max(epoch_us(ts)) AS last_event FROM events")
def metric_time_span(spark, sf_dir):
    return metrics.time_span(_timed(spark, sf_dir), "us")


@query("SELECT event_type AS log_type, count(*) AS events, round(avg(value), 6) AS mean_seconds FROM events GROUP BY 1")
def metric_processed(spark, sf_dir):
    out = metrics.processed(load(spark, sf_dir, "events").withColumnRenamed("event_type", "log_type"), "value")
    return out.withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("SELECT CASE WHEN value <= 1 THEN 0 WHEN value <= 2 THEN 1 WHEN value <= 4 THEN 2 WHEN value <= 8 THEN 3 WHEN value <= 16 THEN 4 WHEN value <= 32 THEN 5 ELSE 6 END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def metric_histogram(spark, sf_dir):
    return metrics.histogram(load(spark, sf_dir, "events"), "value", 1.0, 2.0, 6)
