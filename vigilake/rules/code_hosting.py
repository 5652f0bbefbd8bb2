"""Rules over code hosting logs."""

# The ids, severities and titles of the rules below, and the names and values that their predicates ask for.

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.functions.text import any_of

from .model import Event, FirstSeen, Rule

# Patterns and actions the rules name.
SHELL_INJECTIONS = (
    r"\$\([^)]+\)",
    r"\$\{[^}]*\$\([^)]+\)[^}]*\}",
    r"\$\{[^}]*`[^`]+`[^}]*\}",
    r"<\([^)]+\)",
    r">\([^)]+\)",
    r"/bin/(?:sh|bash|dash|zsh)\s+-c\s+",
    r"(?:bash|sh)\s+-c\s+['\"]",
    r"\\x[0-9a-fA-F]{4,}",
    r"eval\s*\(\s*\$",
    r"exec\s*\(\s*\$",
    r"(?:curl|wget)\s+[^|>]+\|\s*(?:sh|bash)",
    r"nc\s+[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\s+[0-9]+",
)
PACKAGE_MANAGERS = (
    r"npm/\d+\.\d+\.\d+\s+node/v\d+\.\d+\.\d+\s+\w+\s+\w+\s+workspaces/(?:true|false)(?:\s+ci/\w+)?",
    r"yarn/\d+\.\d+\.\d+(?:-core)?\s+npm/\?\s+node/v\d+\.\d+\.\d+\s+\w+\s+\w+",
    r"pip/\d+\.\d+(?:\.\d+)?\s+\{.*\}",
    r"Ruby,\s+RubyGems/\d+\.\d+\.\d+\s+[\w-]+\s+Ruby/\d+\.\d+\.\d+\s+\([^)]+\)",
    r"cargo/\d+\.\d+\.\d+",
)
SKIP_MARKS = (r"\[skip ci\]", r"\[ci skip\]", r"\[no ci\]", r"\[skip actions\]", r"\[actions skip\]", r"skip-checks:\s*true")
SECURITY_ACTIONS = {
    "dependabot_alerts.disable": "CRITICAL", "dependabot_alerts_new_repos.disable": "HIGH", "dependabot_security_updates.disable": "CRITICAL", "dependabot_security_updates_new_repos.disable": "HIGH",
    "repository_secret_scanning_push_protection.disable": "HIGH", "secret_scanning.disable": "CRITICAL", "secret_scanning_new_repos.disable": "HIGH", "bypass": "MEDIUM", "business.disable_oidc": "CRITICAL",
    "business.disable_saml": "CRITICAL", "business.disable_two_factor_requirement": "CRITICAL", "business.members_can_update_protected_branches.disable": "MEDIUM", "business.referrer_override_disable": "MEDIUM",
    "business_advanced_security.disabled": "CRITICAL", "business_advanced_security.disabled_for_new_repos": "HIGH", "business_secret_scanning.disable": "CRITICAL",
    "business_secret_scanning.disabled_for_new_repos": "CRITICAL", "business_secret_scanning_custom_pattern_push_protection.disabled": "HIGH", "business_secret_scanning_push_protection.disable": "CRITICAL",
    "business_secret_scanning_push_protection.disabled_for_new_repos": "HIGH", "business_secret_scanning_push_protection_custom_message.disable": "HIGH", "org.advanced_security_disabled_for_new_repos": "HIGH",
    "org.advanced_security_disabled_on_all_repos": "CRITICAL", "org.advanced_security_policy_selected_member_disabled": "HIGH", "repo.advanced_security_disabled": "CRITICAL",
    "repo.advanced_security_policy_selected_member_disabled": "HIGH", "repository_vulnerability_alerts.disable": "HIGH",
}
AUTH_ACTIONS = ("org.saml_disabled", "org.saml_enabled", "org.disable_two_factor_requirement", "org.enable_two_factor_requirement", "org.update_saml_provider_settings", "org.enable_oauth_app_restrictions", "org.disable_oauth_app_restrictions")
ALLOW_LIST_ACTIONS = ("ip_allow_list.enable", "ip_allow_list.disable", "ip_allow_list.enable_for_installed_apps", "ip_allow_list.disable_for_installed_apps", "ip_allow_list_entry.create", "ip_allow_list_entry.update", "ip_allow_list_entry.destroy")
READING_ACTIONS = ("git.clone", "git.fetch", "git.pull", "git.checkout", "git.archive", "repo.download")
DOWNLOAD_STEPS = ("download artifact", "download-artifact", "actions/download-artifact", "restore artifact", "get artifact", "fetch artifact", "pull artifact")
PULL_REQUEST_ACTIONS = ("opened", "synchronize", "reopened", "closed", "assigned", "unassigned", "labeled", "unlabeled", "edited", "ready_for_review", "converted_to_draft")

REPO, BY = "{repo|<UNKNOWN_REPO>}", "{actor|<UNKNOWN_ACTOR>}"
FULL_NAME = "{repository.full_name|<UNKNOWN_REPO>}"


def injects_shell(text: Column) -> Column:
    """The text holds something a shell would run."""
    return F.coalesce(any_of(text.rlike("(?im)" + p) for p in SHELL_INJECTIONS), F.lit(False))


def injections(text: Column) -> Column:
    """The injections in a text, pattern by pattern."""
    return F.flatten(F.array(*(F.regexp_extract_all(text, F.lit("(?im)(" + p + ")"), F.lit(1)) for p in SHELL_INJECTIONS)))


def is_pull_request(e: Event) -> Column:
    return e.among("action", *PULL_REQUEST_ACTIONS) & e.has("pull_request")


def crosses_forks(e: Event) -> Column:
    """A pull request or run whose head and base are different repositories."""
    head, base = e.s("pull_request.head.repo.full_name"), e.s("pull_request.base.repo.full_name")
    known = F.coalesce((head != "") & (base != ""), F.lit(False))
    differ = lambda a, b: F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))
    listed = e.any("workflow_run.pull_requests", lambda p: differ(p.s("head.repo.id"), p.s("base.repo.id")))
    return F.when(known, head != base).otherwise(listed | differ(e.s("workflow_run.head_repository.id"), e.s("workflow_run.repository.id")))


def reference_url(e: Event) -> Column:
    """Where to look at what happened."""
    return F.coalesce(F.when(is_pull_request(e), e.first_true("pull_request.html_url")), e.first_true("compare"), e.first_true("workflow_run.html_url"), e.first_true("repository.html_url"))


def audit_actor(e: Event) -> Column:
    return F.when(F.startswith(e.kind("actor"), F.lit("OBJECT")), e.first_true("actor.login", "actor.name")).otherwise(e.s("actor"))


def _change(e: Event) -> Column:
    return F.when(e.ends("action", "destroy"), "deleted").when(e.ends("action", "create"), "created").otherwise("modified")


def github_audit(e: Event, monitored: dict[str, tuple[str, ...]] | None = None) -> list[Rule]:
    a = lambda *names: e.among("action", *names)
    watched = any_of(e.eq("repo", r) & e.among("name", *names) for r, names in (monitored or {}).items())
    level = F.lit("Low")
    for name, s in SECURITY_ACTIONS.items():
        level = F.when(e.eq("action", name), s).otherwise(level)
    actor = audit_actor(e)
    hook = F.when(e.ends("action", "create"), "MEDIUM").otherwise("INFO")
    change = _change(e)
    ruleset = F.when(e.eq("ruleset_source_type", "Organization"), e.fmt(f"Github repository ruleset for Organization [{{org|<UNKNOWN_ORG>}}] {{$change}} by [{BY}]", change=change)).otherwise(e.fmt(f"Github repository ruleset for [{REPO}] {{$change}} by [{BY}]", change=change))
    web = e.fmt(f"Github webhook [{{config.url|<UNKNOWN_URL>}}] {{$change}} by [{BY}]", change=change)
    transfer = (
        F.when(a("repo.transfer"), e.fmt("Github User [{actor|NO_ACTOR_FOUND}] accepted a request to receive repository [{repo|NO_REPO_NAME_FOUND}] in [{org|NO_ORG_NAME_FOUND}]."))
        .when(a("repo.transfer_outgoing"), e.fmt("Github User [{actor|NO_ACTOR_FOUND}] transferred repository [{repo|NO_REPO_NAME_FOUND}] in [{org|NO_ORG_NAME_FOUND}]."))
        .when(a("repo.transfer_start"), e.fmt("Github User [{actor|NO_ACTOR_FOUND}] sent a request to transfer repository [{repo|NO_REPO_NAME_FOUND}] to another user or organization."))
    )
    found = F.lit("unknown")
    for p in PACKAGE_MANAGERS:
        m = F.regexp_extract(e.s("user_agent", ""), "(?i)(" + p + ")", 1)
        found = F.when(m != "", m).otherwise(found)
    joined = F.when(a("repo.remove_member"), "removed from").otherwise("added to")
    membership = F.when(a("org.add_member"), "added").when(a("org.remove_member"), "removed").otherwise(e.s("action"))
    first_access = a("git.clone", "git.push", "git.fetch") & ~e.truthy("repository_public") & F.coalesce((actor != "") & ~actor.contains("secret-scanning[bot]"), F.lit(False))
    return [
        e.rule("github_action_failed", a("workflows.completed_workflow_run") & e.eq("conclusion", "failure") & watched, "GitHub Action [{name|<NO_ACTION_NAME>}] in [{repo|<NO_REPO>}] has failed"),
        e.rule("github_advanced_security_change", a(*SECURITY_ACTIONS), "Change detected to GitHub {$adv}Security - {action|}", level, "{actor|<NO_ACTOR>}_{action|<NO_ACTION>}", adv=F.when(e.contains("action", "advanced_security", "secret_scanning"), "Advanced ").otherwise("")),
        e.rule("github_branch_policy_override", a("protected_branch.policy_override"), f"A branch protection requirement in the repository [{REPO}] was overridden by user [{{actor}}] on branch [{{branch|<UNKNOWN_BRANCH>}}]"),
        e.rule("github_branch_protection_disabled", a("protected_branch.destroy"), f"A branch protection was removed from the repository [{REPO}] by [{BY}]"),
        e.rule("github_org_auth_modified", a(*AUTH_ACTIONS), "GitHub auth configuration was changed by {actor|<UNKNOWN USER>}"),
        e.rule("github_org_ip_allowlist", a(*ALLOW_LIST_ACTIONS), "GitHub Org IP Allow list modified by {actor}."),
        e.rule("github_org_moderators_add", a("organization_moderators.add_user"), f"GitHub.Audit: User [{BY}] added user [{{user|<UNKNOWN_USER>}}] to moderators in [{{org|<UNKNOWN_ORG>}}]"),
        e.rule("github_org_modified", a("org.add_member", "org.remove_member"), "GitHub.Audit: User [{actor}] {$did} {user|<UNKNOWN_USER>} to org [{org|<UNKNOWN_ORG>}]", did=membership),
        e.rule("github_organization_app_integration_installed", a("integration_installation.create"), " Github User [{actor}] in [{org}] installed the following integration: [{name}]."),
        e.rule("github_public_repository_created", a("repo.create") & e.eq("visibility", "public"), f"Repository [{REPO}] created with public status by Github user [{{actor}}]."),
        e.rule("github_repo_collaborator_change", a("repo.add_member", "repo.remove_member"), f"Repository collaborator [{{user|<UNKNOWN_USER>}}] {{$did}} repository {REPO}. View current collaborators here: https://github.com/{REPO}/settings/access", F.when(a("repo.remove_member"), "INFO").otherwise("MEDIUM"), did=joined),
        e.rule("github_repo_created", a("repo.create"), f"Repository [{REPO}] created."),
        e.rule("github_repo_hook_modified", e.starts("action", "hook."), f"web hook {{$change}} in repository [{REPO}]", hook, change=change),
        e.rule("github_repo_initial_access", first_access, f"A user [{{$who|}}] accessed a private repository [{REPO}] for the first time.", state=FirstSeen(F.concat_ws(":", F.lit("github_repo_initial_access"), actor, e.s("repo", "None"))), who=actor),
        e.rule("github_repo_ruleset_modified", e.starts("action", "repository_ruleset."), ruleset, F.when(e.ends("action", "create"), "INFO").when(e.ends("action", "update"), "MEDIUM").when(e.ends("action", "destroy"), "HIGH").otherwise("INFO"), "{_document_id|}"),
        e.rule("github_repo_visibility_change", a("repo.access"), f"Repository [{REPO}] visibility changed. View current visibility here: https://github.com/{REPO}/settings/access"),
        e.rule("github_repo_vulnerability_dismissed", a("repository_vulnerability_alert.dismiss"), "GitHub Dependabot Vulnerability Dismissed by {actor}: {repo}"),
        e.rule("github_repository_transfer", a("repo.transfer", "repo.transfer_outgoing", "repo.transfer_start"), transfer),
        e.rule("github_supply_chain_suspicious_user_agents", ~a(*READING_ACTIONS) & e.search("user_agent", *("(?i)" + p for p in PACKAGE_MANAGERS)), "GitHub Supply Chain - Package Manager Modifying Repository ({$found} - {action|})", dedup="{user_agent|}_{actor|<NO_ACTOR>}", found=found),
        e.rule("github_team_modified", a(*(f"team.{x}" for x in ("add_member", "add_repository", "change_parent_team", "create", "destroy", "remove_member", "remove_repository"))), "GitHub.Audit: [{team|<MISSING_TEAM>}] has been modified"),
        e.rule("github_user_access_key_created", a("public_key.create"), "User [{actor}] created a new ssh key"),
        e.rule("github_user_role_updated", a("org.update_member"), "Org owner [{actor}] updated user's [{user}] role ('admin' or 'member')"),
        e.rule("github_webhook_modified", e.starts("action", "hook."), F.when(e.has("repo"), F.concat(web, e.fmt(" in repository [{repo}]"))).otherwise(web), hook),
        e.rule("github_workflow_dispatch_by_github_bot", e.eq("programmatic_access_type", "GitHub App server-to-server token") & e.eq("event", "workflow_dispatch") & e.eq("actor", "github-actions[bot]") & a("workflows.created_workflow_run"), "Bot [{actor}] manually triggered a workflow dispatch for [{name|<NO_WORKFLOW_NAME>}] in [{repo|<NO_REPO>}]"),
        e.rule("github_workflow_permission_modified", a("org.set_default_workflow_permissions") & e.eq("operation_type", "modify"), "Workflow permission settings for GITHUB_TOKENs have been changed for your organization [{org}] by user [{actor}]"),
    ]


def github_webhook(e: Event, intended: bool = False) -> list[Rule]:
    a = lambda *names: e.among("action", *names)
    bad = lambda x, *paths: any_of(injects_shell(x.s(p)) for p in paths)
    crosses = crosses_forks(e)
    fork_level = F.when(crosses, "INFO").otherwise("LOW")
    author = ("message", "author.email", "author.name")
    comment = (e.truthy("comment") & a("created", "edited") & bad(e, "comment.body")) | (e.truthy("review") & a("submitted", "edited") & bad(e, "review.body"))
    in_comment = F.when(e.truthy("comment"), e.fmt(f"Malicious pattern detected in {{$kind}} #{{comment.id|<UNKNOWN>}} in {FULL_NAME} ({{action|<UNKNOWN_ACTION>}})", kind=F.when(e.truthy("pull_request"), "PR comment").otherwise("issue comment"))).when(e.truthy("review"), e.fmt(f"Malicious pattern detected in PR review #{{review.id|<UNKNOWN>}} in {FULL_NAME} ({{action|<UNKNOWN_ACTION>}})")).otherwise(e.fmt(f"Malicious pattern detected in comment/review in {FULL_NAME} ({{action|<UNKNOWN_ACTION>}})"))
    commits = bad(e, *("head_commit." + p for p in author)) | e.any("commits", lambda c: bad(c, *author))
    issue = e.truthy("issue") & a("opened", "edited") & e.eq("issue.state", "open") & bad(e, "issue.title", "issue.body")
    pages = e.any("pages", lambda p: bad(p, "page_name"))
    in_issue = F.when(e.truthy("issue"), e.fmt(f"Malicious pattern detected in issue #{{issue.number|<UNKNOWN_ISSUE_NUMBER>}} in {FULL_NAME} by user [{{issue.user.login|<UNKNOWN_USER>}}]")).when(e.truthy("pages"), e.fmt(f"Malicious pattern detected in wiki page in {FULL_NAME}")).otherwise(e.fmt(f"Malicious pattern detected in {FULL_NAME}"))
    target = F.when(crosses, e.fmt(f"pull_request_target workflow [{{workflow_run.name|<UNKNOWN_WORKFLOW>}}] triggered by cross-fork PR in {FULL_NAME} ({{action|<UNKNOWN_ACTION>}})")).otherwise(e.fmt(f"pull_request_target workflow [{{workflow_run.name|<UNKNOWN_WORKFLOW>}}] triggered in {FULL_NAME} ({{action|<UNKNOWN_ACTION>}})"))
    runner = e.truthy("workflow_job.runner_name") & ~e.starts("workflow_job.runner_name", "GitHub Actions")
    step = lambda parts: e.any("workflow_job.steps", lambda s: s.contains_ci("name", parts))
    exposed = e.eq("repository.visibility", "public") | (e.has("repository.private") & ~e.truthy("repository.private")) | e.truthy("repository.allow_forking")
    skipped = e.any("commits", lambda c: c.search("message", *("(?i)" + p for p in SKIP_MARKS))) if intended else F.lit(False)
    return [
        e.rule("github_crossfork_workflow_run", e.among("workflow_run.event", "pull_request_target", "pull_request") & a("requested") & crosses, f"Workflow [{{workflow_run.name|<UNKNOWN_WORKFLOW>}}] triggered by cross-fork PR in {FULL_NAME} ({{action|<UNKNOWN_ACTION>}})"),
        e.rule("github_malicious_comment_content", comment, in_comment),
        e.rule("github_malicious_commit_content", commits, f"Malicious pattern detected in commit content in {FULL_NAME} on {{ref|<UNKNOWN_REF>}}"),
        e.rule("github_malicious_issue_pages", issue | pages, in_issue),
        e.rule("github_malicious_pr_titles", is_pull_request(e) & a("opened") & bad(e, *(f"pull_request.{p}" for p in ("title", "body", "head.ref", "head.label", "head.repo.default_branch"))), f"Malicious pattern detected in PR #{{pull_request.number|<UNKNOWN>}} in {FULL_NAME} ({{action|<UNKNOWN_ACTION>}})", fork_level),
        e.rule("github_pull_request_target_usage", e.eq("workflow_run.event", "pull_request_target") & a("completed"), target, fork_level),
        e.rule("github_self_hosted_runner_used", a("completed") & runner, "Self-hosted runner '{workflow_job.runner_name|Unknown Runner}' used in workflow '{workflow_job.name|Unknown Workflow}' for {repository.full_name|Unknown Repository}", F.when(exposed, "MEDIUM").otherwise("INFO")),
        e.rule("github_shai_hulud_repo_created", a("created") & e.eq("repository.description", "Sha1-Hulud: The Second Coming."), f"Sha1-Hulud malicious repository [{FULL_NAME}] created by compromised user [{{sender.login|<UNKNOWN_USER>}}]"),
        e.rule("github_workflow_artifact_download", a("completed") & step(DOWNLOAD_STEPS), "Artifact download detected in workflow '{workflow_job.name|Unknown Workflow}' for {repository.full_name|Unknown Repository}"),
        e.rule("github_workflow_contains_checkout", a("completed") & step(["checkout"])),
        e.rule("github_workflow_skip_commits", e.truthy("pusher") & ~e.truthy("repository.private") & e.truthy("repository.allow_forking") & skipped, f"Cross-fork workflow skip commit detected in {FULL_NAME} ({{$sha}})", sha=F.left(e.s("head_commit.id", "<NO_SHA>"), F.lit(8))),
    ]
