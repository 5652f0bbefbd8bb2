"""Rules over Kubernetes audit records."""

# The ids, severities and titles of the rules below, and the names and values that their predicates ask for.

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.functions import net
from vigilake.functions.k8s import COLUMN, SYSTEM_NAMESPACES, K8s, is_sensitive_path
from vigilake.functions.text import any_of

from .model import Event, Rule

# Roles, capabilities, principals, networks and paths the rules name.
PRIVILEGED_ROLES = ("cluster-admin", "system:masters", "admin", "system:kube-controller-manager", "system:kube-scheduler")
DANGEROUS_CAPABILITIES = ("SYS_ADMIN", "NET_ADMIN", "BPF", "SYS_PTRACE", "SYS_MODULE", "DAC_READ_SEARCH", "DAC_OVERRIDE")
WRITE_VERBS = ("create", "update", "patch", "delete", "deletecollection")
SENSITIVE_RESOURCES = ("secrets", "clusterroles", "clusterrolebindings", "roles", "rolebindings")
EXTERNAL_ANNOTATIONS = ("kubernetes.io/ingress.class", "cert-manager.io/cluster-issuer", "external-dns.alpha.kubernetes.io/hostname")
CRITICAL_PATHS = ("/root", ".ssh", "id_rsa", "id_ecdsa", "id_ed25519", "credentials", "secrets", "token", ".kube", "serviceaccount")
HIGH_PATHS = ("/etc", "/var/run", "/proc", "config", "password", "shadow")
MANAGED_ACCOUNTS = ("system:serviceaccount:kube-system:csi-azuredisk-node-sa", "system:serviceaccount:kube-system:csi-azurefile-node-sa", "system:serviceaccount:kube-system:csi-secrets-store-provider-azure", "system:serviceaccount:kube-system:cloud-node-manager")
CLOUD_NETWORKS = {"aws": ("AS16509",), "azure": ("AS8075",), "gcp": ("AS15169", "AS396982")}
HEALTH_PATHS = ("/healthz", "/readyz", "/livez", "/apis/healthz", "/apis/readyz", "/apis/livez")

USER, NAMESPACE, NAME = "<UNKNOWN_USER>", "<UNKNOWN_NAMESPACE>", "<UNKNOWN>"


def _has(items: Column, *values: str) -> Column:
    return F.coalesce(F.arrays_overlap(items, F.array(*map(F.lit, values))), F.lit(False))


def kubernetes(e: Event, v6: bool = False) -> list[Rule]:
    """The unified view stands in the column that ``registry.prepared`` adds."""
    k = K8s(e, F.col(COLUMN))
    obj = k.under("requestObject")
    ok = ~k.failed
    create, role = k.eq("verb", "create"), k.eq("resource", "roles", "clusterroles")
    user, namespace, resource = k.text("username", USER), k.text("namespace", NAMESPACE), k.text("resource", "<UNKNOWN_RESOURCE>")
    named = lambda default: k.text("name", default)
    role_name, role_kind = named("<UNKNOWN_ROLE>"), F.when(k.eq("resource", "clusterroles"), "ClusterRole").otherwise("Role")
    scoped = k.text("namespace")
    pod = create & k.eq("resource", "pods") & ok
    quiet = ~(k.by_system & k.in_system)
    first_ip = F.get(k.ips, F.lit(0))
    t = {"user": user, "ns": namespace, "pod": k.pod, "role": role_name, "kind": role_kind, "resource": resource, "ip": first_ip}

    def in_role(what: str) -> Column:
        return F.when(scoped.isNotNull(), e.fmt(f"[{{$user}}] created {{$kind}} [{{$scope}}/{{$role}}] with {what} permissions", scope=scoped, **t)).otherwise(e.fmt(f"[{{$user}}] created {{$kind}} [{{$role}}] with {what} permissions ", **t))

    rules_of = lambda test: obj.any("rules", test)
    resources = lambda r: r.texts("resources")
    made_role = create & role & ok & ~k.by_system
    cluster = F.when(k.eq("resource", "clusterroles"), "CRITICAL").otherwise("HIGH")
    writes = lambda r: _has(r.texts("verbs"), "create", "update", "patch", "delete")
    writing = F.when(rules_of(lambda r: _has(resources(r), *SENSITIVE_RESOURCES) & writes(r)), "CRITICAL").when(k.eq("resource", "clusterroles") & rules_of(lambda r: _has(resources(r), "pods", "nodes", "persistentvolumes") & writes(r)), "HIGH").when(k.eq("resource", "clusterroles"), "MEDIUM").otherwise("LOW")

    wide_hook = F.exists(k.items("webhooks"), lambda w: Event(w).any("rules", lambda r: _has(r.texts("resources"), "*") | _has(r.texts("apiGroups"), "*")))
    hook_kind = F.when(F.lower(k.text("resource", "webhook")).contains("mutating"), "Mutating").otherwise("Validating")

    allowed = F.coalesce(k.under("annotations").s("authorization\\.k8s\\.io/decision") == "allow", F.lit(False))
    agent, uri = k.text("userAgent", ""), k.text("requestURI", "")
    health = any_of(uri.startswith(p) for p in HEALTH_PATHS)
    own_probe = F.coalesce((F.size(k.ips) == 1) & (first_ip == "127.0.0.1"), F.lit(False)) | F.coalesce((agent == "ELB-HealthChecker/2.0") & first_ip.startswith("10.0."), F.lit(False)) | agent.startswith("kube-probe/") | agent.startswith("GoogleHC/")
    anonymous = F.when(~allowed, "Failed Anonymous Kubernetes API Access Attempt(s) Detected").when(uri == "/version", "Anonymous Kubernetes API Access to /version Endpoint Detected").otherwise(e.fmt("Anonymous API access detected on Kubernetes API server from [{$ip|<UNKNOWN_IP>}] to [{$uri|<UNKNOWN_URI>}]", ip=first_ip, uri=k.text("requestURI")))

    subjects = F.transform(F.filter(obj.items("subjects"), lambda s: Event(s).truthy("kind") & Event(s).truthy("name")), lambda s: F.concat(Event(s).s("kind"), F.lit(":"), Event(s).s("name")))
    subjects = F.nullif(F.array_join(subjects, ", "), F.lit(""))
    tor = F.get(e.texts("p_enrichment.tor_exit_nodes"), F.lit(0))

    args = F.transform(k.command, F.lower)
    first_cf = F.array_position(F.transform(args, lambda a: a.contains("cf") & (a != "-c")), True)
    copies = F.exists(args, lambda a: a.contains("tar")) & (first_cf > 0) & F.exists(F.transform(args, lambda a, i: (a == "-") & (i > 0) & (i + 1 > first_cf)), lambda x: x)
    command = F.array_join(args, " ")
    dash = F.array_position(k.command, "-")
    path = F.when((F.size(k.command) >= 4) & (dash > 0), F.get(k.command, dash.cast("int")))
    contains = lambda parts: any_of(command.contains(p) for p in parts)

    caps = F.array_sort(F.array_distinct(F.array_intersect(F.flatten(F.transform(k.items("containers"), lambda c: Event(c).texts("securityContext.capabilities.add"))), F.array(*map(F.lit, DANGEROUS_CAPABILITIES)))))

    public = F.coalesce(net.is_global(first_ip, v6), F.lit(False))
    outside = ~F.exists(k.ips, lambda ip: F.coalesce(~net.is_global(ip), F.lit(False)))
    node = F.coalesce(user.startswith("system:node:"), F.lit(False))
    network = lambda field, cloud: F.coalesce(k.asn(field).isin(*CLOUD_NETWORKS[cloud]), F.lit(False))
    native_log = k.is_native & ~k.is_cloud
    eks_node = node & F.array_contains(e.texts("user.groups"), "system:nodes") & F.array_contains(e.texts("user.groups"), "system:authenticated") & network("sourceIPs", "aws")
    eks_service = F.coalesce(user.isin("eks:addon-manager", "eks:node-manager"), F.lit(False)) & F.coalesce(F.get(e.texts("user.extra.arn"), F.lit(0)).contains(":assumed-role/AWSWesleyClusterManagerLambda"), F.lit(False))
    azure = e.contains("p_log_type", "Azure.MonitorActivity") & (F.coalesce(user.isin(*MANAGED_ACCOUNTS), F.lit(False)) | (node & network("sourceIPs", "azure")))
    own_cloud = (native_log & (eks_node | eks_service)) | azure | (k.is_cloud & node & network("callerIp", "gcp"))
    system_caller = any_of(user.startswith(p) for p in ("system:serviceaccount:", "system:node:", "eks:", "aks:"))
    from_outside = ~(e.truthy("stage") & ~e.eq("stage", "ResponseComplete")) & ~F.coalesce(k.code == 403, F.lit(False)) & system_caller & (F.size(k.ips) > 0) & outside & ~own_cloud
    place = F.when(scoped.isNotNull(), F.concat(F.lit("in namespace ["), scoped, F.lit("] "))).otherwise("(cluster-scoped) ")

    changed = F.when(k.eq("verb", "delete"), "deleted").otherwise("modified")
    system_role = F.when(scoped.isNotNull(), e.fmt("[{$user}] {$action} system {$kind} [{$scope}/{$role}]", action=changed, scope=scoped, **t)).otherwise(e.fmt("[{$user}] {$action} system {$kind} [{$role}]", action=changed, **t))

    return [
        e.rule("k8s_admission_controller_created", create & k.eq("resource", "mutatingwebhookconfigurations", "validatingwebhookconfigurations") & ok & ~k.by_system, "[{$user}] created {$hook} admission controller webhook [{$name}] ", F.when(wide_hook, "HIGH").otherwise("MEDIUM"), "k8s_admission_webhook_{$user}", hook=hook_kind, name=named("<UNKNOWN_NAME>"), **t),
        e.rule("k8s_anonymous_api_access", k.eq("username", "system:anonymous") & ~own_probe & ~health, anonymous, F.when(~allowed | (uri == "/version"), "INFO").otherwise("DEFAULT"), "anonymous_access_{$agent}", agent=k.text("userAgent", "<UNKNOWN_USER_AGENT>")),
        e.rule("k8s_client_certificate_created", create & k.eq("resource", "certificatesigningrequests") & ok & ~k.by_system & ~k.eq("username", "kubelet-nodepool-bootstrap") & (_has(obj.texts("spec.usages"), "client auth") | obj.contains("spec.signerName", "kubernetes.io/kube-apiserver-client")), "[{$user}] created client certificate signing request [{$name}]", dedup="k8s_client_cert_{$user}_{$name}", name=named("<UNKNOWN_CSR>"), **t),
        e.rule("k8s_clusterrolebinding_privileged", create & k.eq("resource", "clusterrolebindings") & ok & ~k.by_system & obj.among("roleRef.name", *PRIVILEGED_ROLES), "[{$user}] created ClusterRoleBinding [{$name}] granting [{$granted|<UNKNOWN_ROLE>}] to [{$subjects|<UNKNOWN_SUBJECTS>}]", F.when(obj.among("roleRef.name", "cluster-admin", "system:masters"), "HIGH").otherwise("DEFAULT"), "k8s_clusterrolebinding_{$user}_{$name}", name=named("<UNKNOWN_BINDING>"), granted=obj.s("roleRef.name"), subjects=subjects, **t),
        e.rule("k8s_cronjob_created_or_modified", k.eq("verb", "create", "update", "patch") & k.eq("resource", "cronjobs") & ok & ~k.eq("subresource", "status") & quiet, "[{$user}] {$action} CronJob [{$ns}/{$name}]", dedup="k8s_cronjob_{$user}_{$ns}", action=F.when(create, "created").otherwise("modified"), name=named(NAME), **t),
        e.rule("k8s_daemonset_created", create & k.eq("resource", "daemonsets") & ok & quiet, "[{$user}] created DaemonSet [{$ns}/{$name}]", dedup="k8s_daemonset_{$user}_{$ns}", name=named(NAME), **t),
        e.rule("k8s_exec_into_pod", k.eq("verb", "create", "get") & k.eq("resource", "pods") & k.eq("subresource", "exec"), "[{$user}] executed into pod [{$ns}/{$name|<UNKNOWN>}]", dedup="k8s_exec_{$user}_{$ns}_{$name|<UNKNOWN_POD>}", name=k.text("name"), **t),
        e.rule("k8s_ingress_without_tls", create & k.eq("resource", "ingresses") & ok & ~(k.in_system | k.by_system) & ~obj.truthy("spec.tls"), "[{$user}] created Ingress [{$ns}/{$name}] without TLS certificate", F.when(any_of(obj.has("metadata.annotations." + a.replace(".", "\\.")) for a in EXTERNAL_ANNOTATIONS), "MEDIUM").otherwise("DEFAULT"), "k8s_ingress_no_tls_{$ns}_{$name}", name=named("<UNKNOWN_INGRESS>"), **t),
        e.rule("k8s_ioc_activity", k.is_log & e.truthy("p_enrichment.tor_exit_nodes"), "Kubernetes API activity from Tor exit node [{$tor|<UNKNOWN_IP>}] by user [{$user}]", dedup="k8s_tor_{$tor|<UNKNOWN_IP>}", tor=tor, **t),
        e.rule("k8s_kubectl_cp_operation", k.eq("verb", "create", "get") & k.eq("resource", "pods") & k.eq("subresource", "exec") & ok & quiet & F.coalesce(copies, F.lit(False)), "[{$user}] copied data from pod [{$ns}/{$name}] path [{$path|<UNKNOWN_PATH>}] via kubectl cp", F.when(contains(CRITICAL_PATHS), "CRITICAL").when(contains(HIGH_PATHS), "HIGH").otherwise("MEDIUM"), "k8s_kubectl_cp_{$user}_{$ns}_{$name}", name=named("<UNKNOWN_POD>"), path=path, **t),
        e.rule("k8s_multiple_403_public_ip", F.coalesce(k.code.isin(403, 7), F.lit(False)) & public, "Multiple 403 responses from public IP [{$ip|<UNKNOWN_IP>}]", dedup="k8s_403_{$ip|<UNKNOWN_IP>}", **t),
        e.rule("k8s_pod_created_in_system_namespace", pod & k.text("subresource").isNull() & ~k.by_system & k.eq("namespace", *SYSTEM_NAMESPACES), "[{$user}] created pod [{$ns}/{$pod}] in system namespace", dedup="k8s_pod_system_ns_{$user}_{$ns}_{$pod}", **t),
        e.rule("k8s_pod_dangerous_capabilities", pod & ~(k.in_system | k.by_system) & (F.size(caps) > 0), "[{$user}] created pod [{$ns}/{$pod}] with dangerous capabilities [{$caps}]", dedup="k8s_dangerous_caps_{$user}_{$ns}", caps=F.array_join(caps, ", "), **t),
        e.rule("k8s_pod_host_ipc", pod & quiet & k.is_on("hostIPC"), "[{$user}] created pod [{$ns}/{$pod}] with host IPC enabled ", dedup="k8s_host_ipc_{$user}_{$ns}", **t),
        e.rule("k8s_pod_host_network", pod & quiet & k.is_on("hostNetwork"), "[{$user}] created pod [{$ns}/{$pod}] with host network access ", dedup="k8s_host_network_{$user}_{$ns}", **t),
        e.rule("k8s_pod_host_pid", pod & quiet & k.is_on("hostPID"), "[{$user}] created pod [{$ns}/{$pod}] using host PID namespace", **t),
        e.rule("k8s_pod_hostpath_volume", pod & quiet & k.has_host_path, "[{$user}] created pod [{$ns}/{$pod}] with hostPath volume mount [{$paths|unknown}]", F.when(F.exists(k.host_paths, is_sensitive_path), "HIGH").otherwise("MEDIUM"), "hostpath_volume_{$user}_{$ns}", paths=F.nullif(F.array_join(k.host_paths, ", "), F.lit("")), **t),
        e.rule("k8s_privileged_pod_created", pod & quiet & k.privileged, "[{$user}] created a privileged pod [{$ns}/{$pod}]", "HIGH", "privileged_pod_{$user}", **t),
        e.rule("k8s_role_node_proxy_permissions", made_role & rules_of(lambda r: _has(resources(r), "nodes/proxy") | (_has(resources(r), "nodes/*") & (F.size(r.items("verbs")) > 0)) | (_has(resources(r), "nodes") & _has(resources(r), "*"))), "[{$user}] created {$kind} [{$role}] with node proxy permissions", dedup="k8s_node_proxy_{$user}_{$role}", **t),
        e.rule("k8s_role_pod_exec", made_role & rules_of(lambda r: _has(resources(r), "pods/exec")), in_role("pods/exec"), cluster, "k8s_role_podexec_{$user}_{$resource}_{$role}", **t),
        e.rule("k8s_role_wildcard", made_role & rules_of(lambda r: _has(resources(r), "*") | _has(r.texts("verbs"), "*")), in_role("wildcard"), cluster, "k8s_role_wildcard_{$user}_{$resource}_{$role}", **t),
        e.rule("k8s_role_write_permissions", made_role & rules_of(lambda r: _has(r.texts("verbs"), *WRITE_VERBS)), in_role("write"), writing, "k8s_role_write_{$user}_{$resource}_{$role}", **t),
        e.rule("k8s_service_nodeport", create & k.eq("resource", "services") & ok & k.eq("serviceType", "NodePort"), "[{$user}] deployed NodePort service [{$ns}/{$name}]", name=named(NAME), **t),
        e.rule("k8s_system_principal_public_ip", from_outside, "System principal [{$user}] executed [{$verb}] for resource [{$resource}] {$place}from non-cloud public IP [{$ip|<UNKNOWN_IP>}]", dedup="k8s_system_principal_{$ip|<UNKNOWN_IP>}", verb=k.text("verb", "<UNKNOWN_VERB>"), place=place, **t),
        e.rule("k8s_system_role_modified", k.eq("verb", "update", "patch", "delete") & role & ok & ~k.by_system & F.coalesce(k.text("name").startswith("system:") | k.text("name").startswith("eks:"), F.lit(False)) & ~k.eq("name", "system:coredns", "system:managed-certificate-controller"), system_role, dedup="k8s_system_role_{$user}_{$role}", **t),
    ]
