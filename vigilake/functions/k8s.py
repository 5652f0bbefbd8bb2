"""One view of Kubernetes audit records, native (EKS) or by way of Google Cloud's audit log."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.rules.model import Event

from .text import starts_with_any

# Namespaces and identities of the system, and host paths that give away a node.
SYSTEM_NAMESPACES = ("kube-system", "gke-system", "kube-node-lease", "kube-public")
SYSTEM_PREFIXES = (".iam.gserviceaccount.com", "system:serviceaccount:kube-system:", "eks:", "masterclient", "gke-", "azure-")
SYSTEM_NAMES = ("masterclient", "aksService")
SENSITIVE_PATHS = ("/var/lib/kubelet", "/var/lib/docker", "/etc/kubernetes", "/etc/", "/", "/proc", "/sys", "/root", "/home/admin", "/var/run/docker.sock", "/var/run/crio/crio.sock", "/run/containerd/containerd.sock")
#: Paths of the unified keys: in a native record, and in a Google Cloud one where a path gives them.
NATIVE = {
    "annotations": "annotations", "apiGroup": "objectRef.apiGroup", "apiVersion": "objectRef.apiVersion", "namespace": "objectRef.namespace", "resource": "objectRef.resource", "name": "objectRef.name",
    "subresource": "objectRef.subresource", "requestURI": "requestURI", "responseStatus": "responseStatus", "sourceIPs": "sourceIPs", "username": "user.username", "userAgent": "userAgent", "verb": "verb",
    "requestObject": "requestObject", "responseObject": "responseObject", "containers": "requestObject.spec.containers", "volumes": "requestObject.spec.volumes", "hostIPC": "requestObject.spec.hostIPC",
    "hostNetwork": "requestObject.spec.hostNetwork", "hostPID": "requestObject.spec.hostPID", "webhooks": "requestObject.webhooks", "serviceType": "requestObject.spec.type",
}
CLOUD = {
    "annotations": "labels", "responseStatus": "protoPayload.status", "userAgent": "protoPayload.requestMetadata.callerSuppliedUserAgent", "requestObject": "protoPayload.request",
    "responseObject": "protoPayload.response", "containers": "protoPayload.request.spec.containers", "volumes": "protoPayload.request.spec.volumes", "hostIPC": "protoPayload.request.spec.hostIPC",
    "hostNetwork": "protoPayload.request.spec.hostNetwork", "hostPID": "protoPayload.request.spec.hostPID", "webhooks": "protoPayload.request.webhooks", "serviceType": "protoPayload.request.spec.type",
}
KEYS = tuple(NATIVE)
#: The column of the unified view.
COLUMN = "_k8s"
_VARIANTS = ("annotations", "responseStatus", "requestObject", "responseObject", "containers", "volumes", "webhooks", "hostIPC", "hostNetwork", "hostPID")
_TEXTS = tuple(k for k in KEYS if k not in (*_VARIANTS, "sourceIPs"))


def once(c: Column) -> Column:
    """c, worked out once per row: a generator keeps the optimizer from writing it out where it is used."""
    return F.explode(F.array(c))


class K8s:
    """The unified keys of a record as columns. Text keys are null where empty or missing.

    With ``view``, a column made by ``unified``, keys and tests are read from there.
    """

    def __init__(self, e: Event, view: Column | None = None):
        self.e = e
        self.view = view
        if view is not None:
            # tests that many rules share, worked out in the view
            for name in ("code", "failed", "by_system", "in_system", "pod", "is_log", "ips", "is_cloud", "is_native", "command"):
                self.__dict__[name] = view[name]

    @classmethod
    def unified(cls, events: DataFrame, payload: str = "payload", log_type: str = "log_type") -> DataFrame:
        """events with the unified view, in two steps: the keys, then what is derived from them."""
        k = cls(Event(F.col(payload), F.col(log_type)))
        keys = F.struct(*(k.text(n).alias(n) for n in _TEXTS), *(k.variant(n).alias(n) for n in _VARIANTS), k.ips.alias("ips"), k.is_cloud.alias("is_cloud"), k.is_native.alias("is_native"), k.is_log.alias("is_log"))
        first = events.withColumn("_keys", once(keys))
        k = cls(Event(F.col(payload), F.col(log_type)))
        view = F.col("_keys")
        k.view = view
        k.__dict__.update({n: view[n] for n in ("ips", "is_cloud", "is_native", "is_log")})
        derived = {n: getattr(k, n) for n in ("code", "failed", "by_system", "in_system", "pod", "command")}
        whole = F.struct(*(view[n].alias(n) for n in (*_TEXTS, *_VARIANTS, "ips", "is_cloud", "is_native", "is_log")), *(c.alias(n) for n, c in derived.items()))
        return first.withColumn(COLUMN, once(whole)).drop("_keys")

    @cached_property
    def is_cloud(self) -> Column:
        kind = F.coalesce(self.e.s("p_log_type"), self.e.log_type if self.e.log_type is not None else F.lit(None).cast("string"))
        return F.coalesce(kind == "GCP.AuditLog", F.lit(False)) & self.e.eq("protoPayload.serviceName", "k8s.io")

    @cached_property
    def is_native(self) -> Column:
        typed = self.e.eq("p_log_type", "Amazon.EKS.Audit")
        if self.e.log_type is not None:
            typed = typed | F.coalesce(self.e.log_type == "Amazon.EKS.Audit", F.lit(False))
        return typed | (self.e.eq("kind", "Event") & self.e.search("apiVersion", "^audit\\.k8s\\.io/v"))

    @cached_property
    def is_any(self) -> Column:
        return self.is_cloud | self.is_native

    @cached_property
    def _parts(self) -> Column:
        return F.split(self.e.s("protoPayload.resourceName", ""), "/")

    def _part(self, i: int) -> Column:
        return F.nullif(F.get(self._parts, F.lit(i)), F.lit(""))

    def _cloud_text(self, key: str) -> Column:
        e, n = self.e, F.size(self._parts)
        if key == "verb":
            return F.nullif(F.element_at(F.split(e.s("protoPayload.methodName", ""), r"\."), -1), F.lit(""))
        if key == "username":
            a = "protoPayload.authenticationInfo."
            return F.coalesce(e.first_true(a + "principalEmail", a + "principalSubject", a + "authoritySelector"), F.lit("<UNKNOWN ACTOR USER>"))
        if key == "requestURI":
            return F.concat(F.lit("/apis/"), F.nullif(e.s("protoPayload.resourceName"), F.lit("")))
        if key in ("apiGroup", "apiVersion"):
            return self._part(0 if key == "apiGroup" else 1)
        if key == "namespace":
            return F.when((n >= 4) & (self._part(2) == "namespaces"), self._part(3))
        if key == "resource":
            return F.when(n >= 5, self._part(4)).when(n >= 3, self._part(2))
        if key == "name":
            return F.when(n >= 6, self._part(5)).when(n >= 4, self._part(3))
        if key == "subresource":
            return F.when(n > 6, self._part(6))
        return e.s(CLOUD[key])

    def text(self, key: str, default: str | None = None) -> Column:
        if self.view is not None and key in _TEXTS:
            return self.view[key] if default is None else F.coalesce(self.view[key], F.lit(default))
        native = F.when(self.is_native, self.e.s(NATIVE[key]))
        found = F.nullif(F.when(self.is_cloud, self._cloud_text(key)).otherwise(native), F.lit(""))
        return found if default is None else F.coalesce(found, F.lit(default))

    def variant(self, key: str) -> Column:
        if self.view is not None and key in _VARIANTS:
            return self.view[key]
        return F.when(self.is_cloud, self.e.variant(CLOUD[key])).when(self.is_native, self.e.variant(NATIVE[key]))

    def under(self, key: str) -> Event:
        """Accessors over the object at a key."""
        return Event(self.variant(key), self.e.log_type)

    def items(self, key: str) -> Column:
        return F.coalesce(F.try_variant_get(self.variant(key), "$", "array<variant>"), F.array().cast("array<variant>"))

    @cached_property
    def ips(self) -> Column:
        caller = self.e.first_true("protoPayload.requestMetadata.callerIP")
        return F.when(self.is_cloud, F.array_compact(F.array(caller))).when(self.is_native, self.e.texts("sourceIPs")).otherwise(F.array().cast("array<string>"))

    def is_on(self, key: str) -> Column:
        """The key holds the JSON value true."""
        v = self.variant(key)
        return F.coalesce((F.schema_of_variant(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "string") == "true"), F.lit(False))

    def eq(self, key: str, *values: str) -> Column:
        return F.coalesce(self.text(key).isin(*values), F.lit(False))

    @cached_property
    def code(self) -> Column:
        status = self.under("responseStatus")
        return F.when(status.kind("code").rlike("^(TINYINT|SMALLINT|INT|BIGINT)"), status.n("code"))

    @cached_property
    def failed(self) -> Column:
        """HTTP errors, and the error codes 1 to 16 of gRPC."""
        return F.coalesce((self.code >= 400) | self.code.between(1, 16), F.lit(False))

    @cached_property
    def by_system(self) -> Column:
        user = self.text("username", "")
        return is_system_principal(user)

    @cached_property
    def in_system(self) -> Column:
        return is_system_namespace(self.text("namespace"))

    @cached_property
    def pod(self) -> Column:
        return F.coalesce(self.text("name"), self.under("responseObject").first_true("metadata.name"), self.under("requestObject").first_true("metadata.name"), F.lit("<UNKNOWN_POD>"))

    @cached_property
    def is_log(self) -> Column:
        """A record of a cluster, by its log type; Azure's by category."""
        e = self.e
        azure = e.eq("p_log_type", "Azure.MonitorActivity") & e.among("category", "kube-audit", "kube-audit-admin")
        return self.is_cloud | azure | e.eq("p_log_type", "Amazon.EKS.Audit") | (F.coalesce(e.log_type == "Amazon.EKS.Audit", F.lit(False)) if e.log_type is not None else F.lit(False))

    @cached_property
    def host_paths(self) -> Column:
        paths = F.transform(F.filter(self.items("volumes"), lambda v: Event(v).has("hostPath")), lambda v: Event(v).s("hostPath.path"))
        return F.filter(paths, lambda p: F.coalesce(p != "", F.lit(False)))

    @cached_property
    def has_host_path(self) -> Column:
        return F.exists(self.items("volumes"), lambda v: Event(v).has("hostPath"))

    @cached_property
    def privileged(self) -> Column:
        return F.exists(self.items("containers"), lambda c: Event(c).is_true("securityContext.privileged") | Event(c).is_false("securityContext.runAsNonRoot") | F.coalesce(Event(c).n("securityContext.runAsUser") == 0, F.lit(False)))

    @cached_property
    def command(self) -> Column:
        """Arguments of an exec call: of its object, else of its URI's query."""
        given = self.under("requestObject").texts("command")
        query = F.regexp_extract(self.text("requestURI", ""), r"\?([^#]*)", 1)
        found = F.filter(F.split(query, "&"), lambda p: p.startswith("command=") & (F.length(p) > 8))
        return F.when(F.size(given) > 0, given).otherwise(F.transform(found, lambda p: F.try_url_decode(F.substring(p, 9, 100000))))

    def asn(self, field: str) -> Column:
        """Network number that an enrichment found for a field."""
        e = self.e
        one = lambda path: F.coalesce(F.get(e.texts(path), F.lit(0)), F.nullif(e.s(path), F.lit("")))
        return F.coalesce(one(f"p_enrichment.ipinfo.{field}"), one(f"p_enrichment.ipinfo.asns.{field}"))

    @cached_property
    def context(self) -> Column:
        """What an alert tells about the call."""
        names = ("username", "userAgent", "namespace", "verb", "resource", "requestURI", "responseStatus")
        return F.struct(*(self.text(n).alias(n) for n in names), self.ips.alias("sourceIPs"), self.e.s("p_source_label").alias("cluster"))

    @cached_property
    def pod_context(self) -> Column:
        """What an alert tells about a pod: its owners, host settings, containers and volumes."""
        spec = self.under("requestObject")

        def container(c: Column) -> Column:
            x = Event(c)
            env = x.items("env")
            secrets = F.filter(env, lambda v: Event(v).has("name") & Event(v).has("valueFrom.secretKeyRef"))
            return F.struct(
                x.s("name").alias("name"),
                x.s("image").alias("image"),
                F.transform(x.items("ports"), lambda p: Event(p).get("containerPort", "int")).alias("ports"),
                F.filter(F.transform(env, lambda v: Event(v).s("name")), lambda n: n.isNotNull()).alias("env_vars"),
                F.transform(secrets, lambda v: F.struct(Event(v).s("name").alias("env_var"), Event(v).s("valueFrom.secretKeyRef.name").alias("secret_name"), Event(v).s("valueFrom.secretKeyRef.key").alias("secret_key"))).alias("secret_refs"),
                F.transform(F.filter(x.items("volumeMounts"), lambda m: Event(m).truthy("mountPath") & Event(m).truthy("name")), lambda m: F.struct(Event(m).s("mountPath").alias("path"), Event(m).s("name").alias("name"))).alias("volume_mounts"),
                x.s("securityContext", "{}").alias("security_context"),
                x.s("resources", "{}").alias("resources"),
            )

        def volume(v: Column) -> Column:
            x = Event(v)
            kind = F.when(x.has("hostPath"), "hostPath").when(x.has("configMap"), "configMap").when(x.has("secret"), "secret").otherwise("other")
            return F.struct(x.s("name").alias("name"), kind.alias("type"), x.s("hostPath.path").alias("path"), is_sensitive_path(x.s("hostPath.path")).alias("sensitive"), F.coalesce(x.s("configMap.name"), x.s("secret.secretName")).alias("source"))

        return F.struct(
            self.pod.alias("pod_name"),
            F.transform(spec.items("metadata.ownerReferences"), lambda r: F.struct(Event(r).s("kind").alias("kind"), Event(r).s("name").alias("name"))).alias("owner_references"),
            F.struct(*(spec.is_true(f"spec.{n}").alias(n) for n in ("hostPID", "hostIPC", "hostNetwork"))).alias("host_settings"),
            F.transform(self.items("containers"), container).alias("containers"),
            F.transform(self.items("volumes"), volume).alias("volumes"),
        )


def is_system_namespace(namespace: Column) -> Column:
    return F.coalesce(namespace.isin(*SYSTEM_NAMESPACES), F.lit(False))


def is_system_principal(user: Column) -> Column:
    return starts_with_any(user, SYSTEM_PREFIXES) | F.coalesce(user.isin(*SYSTEM_NAMES), F.lit(False)) | F.coalesce(user.startswith("system:") & ~user.contains("serviceaccount"), F.lit(False))


def is_sensitive_path(path: Column) -> Column:
    out = F.lit(False)
    for p in SENSITIVE_PATHS:
        out = out | (path == p) | path.startswith(p + "/")
    return F.coalesce(out, F.lit(False))
