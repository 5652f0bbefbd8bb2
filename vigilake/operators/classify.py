"""Classification: which of the formats a raw record has, and its normalized event.

Precedence is fixed: a valid p_log_type, then the caller's hint, then the
parsers' order. Each record is tested by shape only, so the result does not
depend on what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.ids import row_id
from vigilake.functions.paths import at
from vigilake.schema import IDENTITY, RESOURCES, TEXT_FIELDS

from .parsers import BY_TYPE, PARSERS, VPC_DEFAULT_HEADER, Record, fields_of, is_vpc_header

UNCLASSIFIED = "unclassified"
#: Log types whose payload, the vendor's own record, is what rules read; "intended" adds the text formats and GSuite.
UNWRAPPED = ("Okta.SystemLog", "OnePassword.SignInAttempt", "AWS.BedrockModelInvocation", "GitHub.Audit", "GitHub.Webhook", "GCP.AuditLog", "GCP.HTTPLoadBalancer", "Amazon.EKS.Audit", "Slack.AuditLogs", "Cloudflare.Firewall", "Cloudflare.HttpRequest")
UNWRAPPED_INTENDED = (*UNWRAPPED, "GSuite.Reports", "AWS.VPCFlow", "AWS.ALB", "AWS.S3ServerAccess", "AWS.AuroraMySQLAudit")


def _once(c: Column) -> Column:
    """c, worked out once per row: a generator keeps the optimizer from writing it out where it is used."""
    return F.explode(F.array(c))


def _apart(c: Column) -> Column:
    """As _once, and outside generated code: only the branch that holds is evaluated, and a huge expression is not compiled."""
    return F.explode(F.transform(F.array(c), lambda x: x))


def is_object(json: Column, raw: Column) -> Column:
    """The record is a JSON object, by its first character: its schema would take a walk through all of it. A line that begins with a number parses as JSON up to there."""
    return json.isNotNull() & F.startswith(F.ltrim(raw, F.lit(" \t\r\n")), F.lit("{"))


def _opened(lines: DataFrame, raw: str, header: Column | None) -> tuple[DataFrame, Record]:
    """lines with _json, and with _cells, the fields of what is no JSON; and the record over them."""
    r = F.col(raw)
    parsed = lines.withColumn("_json", _once(F.try_parse_json(r)))
    text = ~is_object(F.col("_json"), r)
    cells = F.struct(F.when(text, fields_of(r, " ")).alias("spaced"), F.when(text, fields_of(r, ",")).alias("commaed"))
    return parsed.withColumn("_cells", _once(cells)), Record(r, F.col("_json"), header, F.col("_cells.spaced"), F.col("_cells.commaed"))


def accepted(r: Record) -> Column:
    """For each parser, in order, whether it takes the record."""
    takes = lambda json: F.array(*(F.coalesce(p.accept(r), F.lit(False)) if p.json == json else F.lit(False) for p in PARSERS))
    return F.when(is_object(r.json, r.raw), takes(True)).otherwise(takes(False))


def log_type_of(accepts: Column, own: Column, hint: Column | None = None) -> Column:
    """A record's own type, the hint, then the first parser that takes it."""
    names = F.array(*(F.lit(p.log_type) for p in PARSERS))
    taken = F.array_compact(F.zip_with(names, accepts, lambda n, ok: F.when(ok, n)))
    told = F.when(F.array_contains(taken, own), own)
    if hint is not None:
        told = F.coalesce(told, F.when(F.array_contains(taken, hint), hint))
    return F.coalesce(told, F.get(taken, F.lit(0)))


def with_headers(lines: DataFrame, file: str, raw: str = "raw", header: str = "header") -> DataFrame:
    """lines with the flow-log header of their file; a file without one gets the default. Headers are few rows, one per file."""
    found = lines.where(is_vpc_header(F.col(raw))).groupBy(file).agg(F.min(raw).alias(header))
    return lines.drop(header).join(found, file, "left")


def _typed(lines: DataFrame, raw: str, hint: str | None, header: str | None, keep_unclassified: bool) -> tuple[DataFrame, Record]:
    """lines with their log type, and the record over them."""
    head = F.coalesce(F.col(header), F.lit(VPC_DEFAULT_HEADER)) if header else None
    parsed, r = _opened(lines.where(F.trim(F.col(raw)) != ""), raw, head)
    typed = parsed.withColumn("_accepts", _once(accepted(r)))
    typed = typed.withColumn("log_type", _once(log_type_of(F.col("_accepts"), at(F.col("_json"), "p_log_type"), F.col(hint) if hint else None))).drop("_accepts")
    return (typed.withColumn("log_type", F.coalesce("log_type", F.lit(UNCLASSIFIED))) if keep_unclassified else typed.where("log_type is not null")), r


def classify(lines: DataFrame, raw: str = "raw", hint: str | None = None, header: str | None = None, keep_unclassified: bool = False) -> DataFrame:
    """lines' columns with log_type and the envelope.

    Records that no parser accepts, flow-log headers and blank lines have no
    log type; they are left out unless ``keep_unclassified``.
    """
    typed, r = _typed(lines, raw, hint, header, keep_unclassified)
    kinds = {n: "string" for n in TEXT_FIELDS} | {"eventTime": "timestamp", "userIdentity": IDENTITY, "requestParameters": "variant", "responseElements": "variant", "resources": RESOURCES}
    defaults = {n: F.lit("1.0") if n == "eventVersion" else F.lit("") if kind == "string" else F.lit(None).cast(kind) for n, kind in kinds.items()}

    def envelope(own: dict[str, Column]) -> Column:
        return F.struct(*((F.coalesce(own[n], F.lit("")) if kind == "string" else own[n].cast(kind)).alias(n) if n in own else defaults[n].alias(n) for n, kind in kinds.items()))

    # one choice for the whole envelope, so a record costs the fields of its own format
    whole = F
    for p in PARSERS:
        whole = whole.when(F.col("log_type") == p.log_type, envelope(p.fields(r)))
    whole = whole.otherwise(envelope({}))
    made = typed.withColumn("_envelope", _apart(whole)).select(*typed.columns, *(F.col("_envelope")[n].alias(n) for n in kinds))
    return made.withColumn("rowID", row_id(F.col("eventID"), F.col("eventTime"))).withColumnRenamed("_json", "_raw").drop("_cells")


def envelope_variant() -> Column:
    """The envelope as rules see it where the payload is not unwrapped."""
    names = (*TEXT_FIELDS, "userIdentity", "requestParameters", "responseElements", "resources")
    plain = [F.col(n).alias(n) for n in names if n not in ("requestParameters", "responseElements")]
    when = F.date_format("eventTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime")
    return F.parse_json(F.to_json(F.struct(*plain, when, F.col("requestParameters"), F.col("responseElements")), {"ignoreNullFields": "false"}))


def with_payload(events: DataFrame, mode: str = "reference") -> DataFrame:
    """events with ``payload``, what rules read.

    "reference": the vendor's record for the types that are unwrapped, else the
    envelope, which has lost what it has no field for. "intended": the vendor's
    record for every type.
    """
    if mode == "intended":
        return events.withColumn("payload", F.when(F.col("log_type").isin(*UNWRAPPED_INTENDED), F.coalesce("requestParameters", "_raw")).otherwise(F.coalesce("_raw", "requestParameters")))
    if mode != "reference":
        raise ValueError(f"mode {mode!r}: reference or intended")
    return events.withColumn("payload", F.when(F.col("log_type").isin(*UNWRAPPED), F.col("requestParameters")).otherwise(envelope_variant()))


def infer_log_type(payload: Column) -> Column:
    """Log type of an event that was not classified: p_log_type, then eventSource and eventName, else CloudTrail."""
    by_source = {"okta.com": "Okta.SystemLog", "gsuite.google.com": "GSuite.Reports", "1password.com": "OnePassword.SignInAttempt", "github.com.webhook": "GitHub.Webhook", "github.com": "GitHub.Audit", "loadbalancing.googleapis.com": "GCP.HTTPLoadBalancer", "cloudaudit.googleapis.com": "GCP.AuditLog", "eks.amazonaws.com": "Amazon.EKS.Audit", "cloudflare.com.http_request": "Cloudflare.HttpRequest", "cloudflare.com.firewall": "Cloudflare.Firewall", "slack.com": "Slack.AuditLogs"}
    source, name, own = at(payload, "eventSource"), at(payload, "eventName"), at(payload, "p_log_type")
    out = F.when(own != "", own)
    for s, t in by_source.items():
        out = out.when(source == s, t)
    out = out.when(at(payload, "operation").isin("InvokeModel", "Converse") & (at(payload, "modelId") != ""), "AWS.BedrockModelInvocation")
    out = out.when((source == "vpcflowlogs.amazonaws.com") | (name == "VPCFlow"), "AWS.VPCFlow")
    out = out.when((source == "elasticloadbalancing.amazonaws.com") & name.startswith("ALB"), "AWS.ALB")
    return out.otherwise("AWS.CloudTrail")


# CloudTrail event sources and the service each belongs to.
SERVICE_TYPES = {
    "cloudtrail.amazonaws.com": "AWS.CloudTrail", "s3.amazonaws.com": "AWS.S3", "ec2.amazonaws.com": "AWS.EC2", "iam.amazonaws.com": "AWS.IAM", "sts.amazonaws.com": "AWS.STS",
    "kms.amazonaws.com": "AWS.KMS", "lambda.amazonaws.com": "AWS.Lambda", "rds.amazonaws.com": "AWS.RDS", "dynamodb.amazonaws.com": "AWS.DynamoDB", "logs.amazonaws.com": "AWS.CloudWatchLogs",
    "guardduty.amazonaws.com": "AWS.GuardDuty", "config.amazonaws.com": "AWS.Config", "cloudformation.amazonaws.com": "AWS.CloudFormation", "elasticloadbalancing.amazonaws.com": "AWS.ELB",
    "redshift.amazonaws.com": "AWS.Redshift", "ecs.amazonaws.com": "AWS.ECS", "secretsmanager.amazonaws.com": "AWS.SecretsManager", "ssm.amazonaws.com": "AWS.SSM",
}


def service_type(event_source: Column) -> Column:
    """Service of a CloudTrail event by its eventSource."""
    table = F.create_map(*(F.lit(x) for kv in SERVICE_TYPES.items() for x in kv))
    by_prefix = F.when(event_source.startswith("s3."), "AWS.S3").when(event_source.startswith("ec2."), "AWS.EC2").when(event_source.startswith("iam."), "AWS.IAM")
    return F.coalesce(F.try_element_at(table, event_source), by_prefix, F.lit("AWS.CloudTrail"))


def classifier_stats(lines: DataFrame, raw: str = "raw", **options) -> DataFrame:
    """Records and bytes per log type, those that no parser accepts included."""
    typed, _ = _typed(lines, raw, options.get("hint"), options.get("header"), True)
    return typed.groupBy("log_type").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length(raw)).alias("bytes"))


def parse_as(lines: DataFrame, log_type: str, raw: str = "raw") -> DataFrame:
    """Records of one known format only: a plan with that parser alone."""
    p = BY_TYPE[log_type]
    parsed, r = _opened(lines, raw, None)
    return parsed.where(F.coalesce(p.accept(r), F.lit(False))).withColumns(p.fields(r)).withColumn("log_type", F.lit(log_type)).withColumnRenamed("_json", "_raw").drop("_cells")
