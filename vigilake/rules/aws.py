"""Rules over AWS logs."""

# The ids, severities and titles of the rules below, and the names and values that their predicates ask for.

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.functions import aws, net
from vigilake.functions.text import any_of

from .model import Event, Rule

BY = " by [{userIdentity.arn|UNKNOWN}]"
BY_ACTOR = " by [{$actor}]"

# Names of files that extortionists leave.
RANSOM_NOTES = (
    r"(?i)(ransom|payment)[_-]?(note|info|instructions?).*\.(txt|html?)$",
    r"(?i)how[_-]?to[_-]?(decrypt|restore|recover)[_-]?(your[_-]?)?files.*\.(txt|html?)$",
    r"(?i)decrypt[_-]?(instructions?|guide|info|your[_-]?files).*\.(txt|html?)$",
    r"(?i)restore[_-]?(instructions?|guide|info|your[_-]?files).*\.(txt|html?)$",
    r"(?i)recovery[_-]?(instructions?|key|guide).*\.(txt|html?)$",
    r"(?i)(all[_-]?)?files?[_-]?(have[_-]?been[_-]?)?(encrypted|locked).*\.(txt|html?)$",
    r"(?i)your[_-]?files?[_-]?(are|have[_-]?been)[_-]?(encrypted|locked).*\.(txt|html?)$",
    r"(?i)data[_-]?(has[_-]?been[_-]?)?(encrypted|locked).*\.(txt|html?)$",
    r"(?i)unlock[_-]?(instructions?|guide|your[_-]?files).*\.(txt|html?)$",
    r"(?i)help[_-]?(restore|decrypt|recover)[_-]?(your[_-]?)?files.*\.(txt|html?)$",
)
README_NOTE = r"(?i)readme[_-]?(decrypt|ransom|locked).*\.(txt|html?)$"


def looks_like_ransom_note(name: Column, patterns) -> Column:
    """The name begins with one of the patterns."""
    return F.coalesce(any_of(name.rlike("^(?:" + p + ")") for p in patterns), F.lit(False))


def aws_alb(e: Event) -> list[Rule]:
    elb, target = F.coalesce(e.n("elbStatusCode"), F.lit(0)), F.coalesce(e.n("targetStatusCode"), F.lit(0))
    error = lambda c: (c >= 400) & (c < 600)
    agents = ("sqlmap", "nikto", "nmap", "masscan", "zmap", "masscan", "dirb", "gobuster", "wfuzz", "burp", "acunetix", "nessus", "openvas", "w3af", "scanner", "bot", "crawler", "spider")
    return [
        e.rule("aws_alb_high_error_rate", error(elb) | error(target), "High error rate detected: ELB={elbStatusCode|N/A}, Target={targetStatusCode|N/A} from {clientIP|UNKNOWN}", "LOW"),
        e.rule("aws_alb_suspicious_user_agent", e.contains_ci("userAgent", agents), "Suspicious user agent detected: {userAgent|UNKNOWN} from {clientIP|UNKNOWN}", "MEDIUM"),
    ]


def aws_bedrockmodelinvocation(e: Event) -> list[Rule]:
    paths = ("output.outputBodyJSON", "output.outputBodyJson")
    first = lambda tail: F.when(e.truthy(paths[0]), e.s(f"{paths[0]}.{tail}")).otherwise(e.s(f"{paths[1]}.{tail}"))
    stop, reason = first("stopReason"), first("amazon-bedrock-trace.guardrail.actionReason")
    hit = e.among("operation", "InvokeModel", "Converse") & (F.coalesce(stop == "guardrail_intervened", F.lit(False)) | F.coalesce(reason.startswith("Guardrail blocked"), F.lit(False)))
    base = "The model [{modelId}] was invoked with the operation [{operation}] by the account [{accountId}]."
    title = F.when(reason.isNull(), e.fmt(base + " Stop reason [{$stop|<UNKNOWN REASON>}].", stop=stop)).when(stop.isNull(), e.fmt(base + " Action reason [{$reason}].", reason=reason)).otherwise(e.fmt(base + " Stop reason [{$stop}]. Action reason [{$reason}].", stop=stop, reason=reason))
    return [e.rule("aws_bedrockmodelinvocation_guardrail_intervened", hit, title, "INFO")]


def _s3_filename(e: Event) -> Column:
    objects = F.filter(e.items("resources"), lambda x: (Event(x).eq("type", "AWS::S3::Object")) & F.coalesce(_arn(Event(x)).contains("/"), F.lit(False)))
    found = _arn(Event(F.get(objects, F.lit(0))))
    key = F.coalesce(e.first_true("requestParameters.key"), F.regexp_extract(found, "^[^/]*/(.*)$", 1))
    return F.element_at(F.split(key, "/"), -1)


def _arn(x: Event) -> Column:
    return F.coalesce(x.s("arn"), x.s("ARN"))


def _copy_accounts(e: Event) -> tuple[Column, Column]:
    """Different buckets among the resources, and different accounts of them; a bucket's last account counts."""
    pairs = F.transform(F.filter(e.items("resources"), lambda x: Event(x).eq("type", "AWS::S3::Bucket")), lambda x: F.struct(F.element_at(F.split(_arn(Event(x)), ":::"), -1).alias("b"), Event(x).s("accountId").alias("a")))
    pairs = F.filter(pairs, lambda p: F.coalesce((p.b != "") & (p.a != ""), F.lit(False)))
    buckets = F.array_distinct(F.transform(pairs, lambda p: p.b))
    accounts = F.array_distinct(F.transform(buckets, lambda b: F.element_at(F.filter(pairs, lambda p: p.b == b), -1).a))
    return F.size(buckets), F.size(accounts)


def aws_cloudtrail(e: Event) -> list[Rule]:
    ok, rp = e.succeeded, "requestParameters."
    bucket = "[{requestParameters.bucketName|UNKNOWN}]"
    actor = {"actor": e.actor}

    # titles that depend on the event
    name = e.s("eventName", "")
    internet = name.contains("InternetGateway")
    gateway = F.when(internet, F.coalesce(e.s("responseElements.internetGateway.internetGatewayId"), e.s(rp + "internetGatewayId"), F.lit("UNKNOWN"))).otherwise(e.s("responseElements.natGateway.natGatewayId", "UNKNOWN"))
    gateway_vpc = F.when(internet, e.s(rp + "vpcId", "N/A")).otherwise(e.s("responseElements.natGateway.vpcId", "N/A"))
    gateway_action = F.lower(F.replace(F.replace(name, F.lit("InternetGateway"), F.lit("")), F.lit("NatGateway"), F.lit("")))
    root_user = F.when(e.eq("userIdentity.type", "Root"), "root user").otherwise(e.s("userIdentity.userName", "UNKNOWN"))
    mfa_user = F.when(e.eq("userIdentity.type", "Root"), "the root user").otherwise(
        F.concat(F.lower(e.s("userIdentity.sessionContext.sessionIssuer.type", "user")), F.lit(" "), F.coalesce(e.first_true("userIdentity.userName"), e.s("userIdentity.sessionContext.sessionIssuer.userName"), F.lit("UNKNOWN")))
    )
    created = F.when(name == "CreateUser", e.fmt("created user [{requestParameters.userName|UNKNOWN}]")).when(name == "CreateRole", e.fmt("created role [{requestParameters.roleName|UNKNOWN}]")).otherwise(e.fmt("created access key for [{requestParameters.userName|UNKNOWN}]"))
    policy_target = F.coalesce(e.first_true(*(rp + x for x in ("userName", "roleName", "groupName", "policyArn"))), F.lit("UNKNOWN"))
    snapshot = F.when(name == "DeleteDBSnapshot", e.s(rp + "dBSnapshotIdentifier", "UNKNOWN")).otherwise(e.s(rp + "dBClusterSnapshotIdentifier", "UNKNOWN"))
    source = e.s(rp + "x-amz-copy-source", "UNKNOWN")
    targets = F.size(e.items(rp + "instanceIds"))
    flow_ids = e.texts(rp + "DeleteFlowLogsRequest.FlowLogId")
    flows = F.concat(F.array_join(F.slice(flow_ids, 1, 3), ", "), F.when(F.size(flow_ids) > 3, F.concat(F.lit(" (and "), (F.size(flow_ids) - 3).cast("string"), F.lit(" more)"))).otherwise(""))
    note = _s3_filename(e)

    # conditions of more than names
    open_ports = (22, 3389, 3306, 5432, 1433, 27017)
    world = e.any(rp + "ipPermissions.items", lambda p: p.any("ipRanges.items", lambda r: r.eq("cidrIp", "0.0.0.0/0")) & F.coalesce(p.n("fromPort").isin(*open_ports), F.lit(False)))
    public_grant = e.any(rp + "AccessControlPolicy.AccessControlList.Grant", lambda g: g.contains("Grantee.URI", "AllUsers", "AuthenticatedUsers"))
    block = rp + "PublicAccessBlockConfiguration."
    arn = e.s("userIdentity.arn", "")
    no_mfa = e.named("ConsoleLogin") & ~arn.contains("AWSReservedSSO") & ~e.has("additionalEventData.SamlProviderArn") & e.eq("responseElements.ConsoleLogin", "Success") & ~e.eq("additionalEventData.MFAUsed", "Yes") & ~e.eq("userIdentity.sessionContext.attributes.mfaAuthenticated", "true")
    n_buckets, n_accounts = _copy_accounts(e)
    owner = e.s("responseElements.accessKey.userName", "")
    allowed_agents = ("aws-cli", "Boto3", "aws-sdk", "terraform", "Pulumi", "CloudFormation", "console.aws.amazon.com")
    iam_calls = ("CreateUser", "CreateRole", "AttachUserPolicy", "AttachRolePolicy", "PutUserPolicy", "PutRolePolicy", "CreateAccessKey", "UpdateAccessKey")
    login_actor = F.coalesce(e.first_true("userIdentity.userName"), e.first_true("userIdentity.sessionContext.sessionIssuer.userName"), F.lit(""))
    interactive = e.among("userIdentity.type", "IAMUser", "FederatedUser") | (e.eq("userIdentity.type", "AssumedRole") & e.starts("userIdentity.sessionContext.sessionIssuer.userName", "AWSReservedSSO_"))
    lambda_name = F.coalesce(e.s("responseElements.functionName"), e.s(rp + "functionName"), F.lit("UNKNOWN"))
    lock = rp + "ObjectLockConfiguration.ObjectLockEnabled"
    mfa_delete = rp + "VersioningConfiguration.MfaDelete"

    return [
        e.rule("aws_cloudtrail_stopped", ok & e.named("StopLogging", "DeleteTrail", "UpdateTrail"), "CloudTrail [{requestParameters.name|UNKNOWN}] {eventName|UNKNOWN}" + BY, "HIGH"),
        e.rule("aws_config_service_disabled", ok & e.named("DeleteConfigurationRecorder", "DeleteDeliveryChannel", "StopConfigurationRecorder"), "AWS Config {eventName|UNKNOWN}" + BY, "HIGH"),
        e.rule("aws_console_login_failed", e.named("ConsoleLogin") & e.eq("responseElements.ConsoleLogin", "Failure"), "Failed console login for [{$user}] from [{sourceIPAddress|UNKNOWN}]", "INFO", user=root_user),
        e.rule("aws_console_login_without_mfa", no_mfa, "AWS login detected without MFA for [{$user}] in [{recipientAccountId|UNKNOWN}]", "MEDIUM", user=mfa_user),
        e.rule("aws_console_root_login", e.named("ConsoleLogin") & e.eq("userIdentity.type", "Root") & e.eq("responseElements.ConsoleLogin", "Success"), "AWS root login detected from {sourceIPAddress|unknown} in account [{$account}]", "CRITICAL", account=e.account),
        e.rule("aws_ebs_snapshot_deleted", ok & e.named("DeleteSnapshot"), "EBS snapshot [{requestParameters.snapshotId|UNKNOWN}] deleted" + BY, "HIGH"),
        e.rule("aws_ec2_download_instance_user_data", ok & e.named("DescribeInstanceAttribute") & e.eq(rp + "attribute", "userData"), "EC2 user data downloaded for instance [{requestParameters.instanceId|UNKNOWN}]" + BY, "HIGH"),
        e.rule("aws_ec2_gateway_modified", ok & e.named("CreateInternetGateway", "AttachInternetGateway", "CreateNatGateway"), "{$kind} [{$id}] {$action}d in VPC [{$vpc}]" + BY, "MEDIUM", kind=F.when(internet, "Internet Gateway").otherwise("NAT Gateway"), id=gateway, action=gateway_action, vpc=gateway_vpc),
        e.rule("aws_ec2_instance_modified_for_persistence", ok & e.named("ModifyInstanceAttribute"), "EC2 instance [{requestParameters.instanceId|UNKNOWN}] attributes modified" + BY, "MEDIUM"),
        e.rule("aws_ec2_network_acl_modified", ok & e.named("CreateNetworkAclEntry", "ReplaceNetworkAclEntry", "DeleteNetworkAclEntry"), "Network ACL [{requestParameters.networkAclId|UNKNOWN}] {eventName|UNKNOWN}" + BY, "MEDIUM"),
        e.rule("aws_ec2_security_group_modified", ok & e.named("AuthorizeSecurityGroupIngress") & world, "Risky security group rule added to [{requestParameters.groupId|UNKNOWN}]" + BY, "HIGH"),
        e.rule("aws_ec2_snapshot_made_public", ok & e.named("ModifySnapshotAttribute") & e.any(rp + "createVolumePermission.add.items", lambda x: x.eq("group", "all")), "EBS snapshot [{requestParameters.snapshotId|UNKNOWN}] made public" + BY, "CRITICAL"),
        e.rule("aws_ec2_startup_script_changed", ok & e.named("ModifyInstanceAttribute") & e.has(rp + "userData"), "EC2 startup script (userData) modified for [{requestParameters.instanceId|UNKNOWN}]" + BY, "HIGH"),
        e.rule("aws_ec2_vpc_route_table_modified", ok & e.named("CreateRoute", "ReplaceRoute", "DeleteRoute"), "VPC route table [{requestParameters.routeTableId|UNKNOWN}] modified: {$action} for [{requestParameters.destinationCidrBlock|UNKNOWN}]" + BY, "MEDIUM", action=F.lower(F.replace(name, F.lit("Route"), F.lit(" route")))),
        e.rule("aws_ecr_image_pushed", ok & e.named("PutImage"), "Container image [{requestParameters.imageTag|UNKNOWN}] pushed to ECR repo [{requestParameters.repositoryName|UNKNOWN}]" + BY, "INFO"),
        e.rule("aws_guardduty_disabled", ok & e.named("DeleteDetector", "DeleteMembers", "DisassociateFromMasterAccount", "DisassociateMembers", "StopMonitoringMembers", "UpdateDetector"), "GuardDuty {eventName|UNKNOWN}" + BY, "HIGH"),
        e.rule("aws_iam_assume_role_blacklist", ok & e.named("AssumeRole") & e.contains(rp + "roleArn", "Admin", "PowerUser", "OrganizationAccountAccess", "Production"), "Sensitive role [{requestParameters.roleArn|UNKNOWN}] assumed" + BY, "MEDIUM"),
        e.rule("aws_iam_attach_admin_user_policy", ok & e.named("AttachUserPolicy") & e.ends(rp + "policyArn", "AdministratorAccess"), "AdministratorAccess policy attached to user [{requestParameters.userName|UNKNOWN}]" + BY, "HIGH"),
        e.rule("aws_iam_backdoor_users", ok & e.named("CreateUser") & e.among("userIdentity.type", "AssumedRole", "AWSService"), "IAM user [{requestParameters.userName|UNKNOWN}] created by [{userIdentity.type|UNKNOWN}]: [{userIdentity.arn|UNKNOWN}]", "HIGH"),
        e.rule("aws_iam_entity_creation_by_new_user", ok & e.named("CreateUser", "CreateRole", "CreateAccessKey") & e.eq("userIdentity.type", "IAMUser"), "IAM user [{userIdentity.userName|UNKNOWN}] {$action}", "MEDIUM", action=created),
        e.rule("aws_iam_policy_modified", ok & e.named("PutUserPolicy", "PutRolePolicy", "PutGroupPolicy", "CreatePolicyVersion", "SetDefaultPolicyVersion"), "IAM policy {eventName|UNKNOWN} on [{$target}]" + BY, "MEDIUM", target=policy_target),
        e.rule("aws_iam_unusual_user_agent", ok & e.named(*iam_calls) & ~e.contains_ci("userAgent", allowed_agents), "Sensitive IAM operation [{eventName}] by [{userIdentity.arn|UNKNOWN}] with unusual user agent: [{userAgent|UNKNOWN}]", "MEDIUM"),
        e.rule("aws_iam_user_created", ok & e.named("CreateUser"), "IAM user [{requestParameters.userName|UNKNOWN}] created" + BY, "MEDIUM"),
        e.rule("aws_iam_user_key_created", ok & e.eq("eventSource", "iam.amazonaws.com") & e.named("CreateAccessKey") & ~F.endswith(arn, F.concat(F.lit("user/"), owner)), "[{userIdentity.arn|UNKNOWN}] created API keys for [{responseElements.accessKey.userName|UNKNOWN}]", "HIGH"),
        e.rule("aws_iam_user_login_profile_modified", ok & e.named("CreateLoginProfile", "UpdateLoginProfile") & (login_actor != "") & (e.s(rp + "userName", "") != "") & (login_actor != e.s(rp + "userName", "")), "Login profile {$action} for user [{requestParameters.userName|UNKNOWN}]" + BY, "MEDIUM", action=F.when(name == "CreateLoginProfile", "created").otherwise("modified")),
        e.rule("aws_kms_key_disabled_or_scheduled_deletion", ok & e.named("DisableKey", "ScheduleKeyDeletion"), "KMS key [{requestParameters.keyId|UNKNOWN}] {eventName|UNKNOWN}" + BY, "HIGH"),
        e.rule("aws_lambda_function_modified", ok & e.named("UpdateFunctionCode20150331v2", "UpdateFunctionConfiguration20150331v2", "AddPermission20150331v2", "CreateFunction20150331v2"), "Lambda function [{requestParameters.functionName|UNKNOWN}] {$name}" + BY, F.when(e.contains("eventName", "UpdateFunctionCode", "CreateFunction"), "HIGH").otherwise("MEDIUM"), name=F.replace(e.s("eventName", "UNKNOWN"), F.lit("20150331v2"), F.lit(""))),
        e.rule("aws_lambda_update_function_code_interactive_identity", ok & e.eq("eventSource", "lambda.amazonaws.com") & e.starts("eventName", "UpdateFunctionCode") & interactive, "[AWS.CloudTrail] User [{$actor}] updated Lambda function code for [{$name}]", "HIGH", name=lambda_name, **actor),
        e.rule("aws_rds_snapshot_deleted", ok & e.named("DeleteDBSnapshot", "DeleteDBClusterSnapshot"), "RDS snapshot [{$id}] deleted" + BY, "HIGH", id=snapshot),
        e.rule("aws_rds_snapshot_shared_publicly", ok & e.named("ModifyDBSnapshotAttribute") & (F.array_contains(e.texts(rp + "valuesToAdd"), "all") | ((e.kind(rp + "valuesToAdd") == "STRING") & e.contains(rp + "valuesToAdd", "all"))), "RDS snapshot [{requestParameters.dBSnapshotIdentifier|UNKNOWN}] shared publicly" + BY, "CRITICAL"),
        e.rule("aws_root_access_key_created", e.named("CreateAccessKey") & e.eq("userIdentity.type", "Root") & ~e.has("requestParameters"), "ROOT ACCESS KEY CREATED in account [{recipientAccountId|UNKNOWN}] - IMMEDIATE ACTION REQUIRED", "CRITICAL"),
        e.rule("aws_s3_access_logging_disabled", ok & e.named("PutBucketLogging") & ~e.has(rp + "BucketLoggingStatus.LoggingEnabled"), f"S3 access logging disabled for bucket {bucket}" + BY, "MEDIUM"),
        e.rule("aws_s3_bucket_deleted", ok & e.named("DeleteBucket"), f"S3 bucket {bucket} deleted" + BY, "HIGH"),
        e.rule("aws_s3_bucket_encryption_deleted", ok & e.named("DeleteBucketEncryption"), f"S3 bucket encryption deleted on {bucket}" + BY_ACTOR, "MEDIUM", **actor),
        e.rule("aws_s3_bucket_public_access", ok & ((e.named("PutBucketAcl", "PutBucketPolicy") & public_grant) | (e.named("PutPublicAccessBlock") & (~e.truthy(block + "BlockPublicAcls") | ~e.truthy(block + "BlockPublicPolicy")))), f"S3 bucket {bucket} public access change via {{eventName|UNKNOWN}}" + BY, "HIGH"),
        e.rule("aws_s3_cross_account_copy", ok & e.named("CopyObject") & (n_buckets >= 2) & (n_accounts > 1), f"S3 cross-account copy from [{{$source}}] to {bucket}" + BY_ACTOR, "HIGH", source=F.get(F.split(source, "/"), F.lit(0)), **actor),
        e.rule("aws_s3_logging_disabled", ok & e.named("PutBucketLogging") & (~e.has(rp + "BucketLoggingStatus.LoggingEnabled") | e.eq(rp + "BucketLoggingStatus.LoggingEnabled", "{}")), f"S3 bucket logging disabled on {bucket}" + BY_ACTOR, "MEDIUM", **actor),
        e.rule("aws_s3_mfa_delete_disabled", ok & e.named("PutBucketVersioning") & e.among(mfa_delete, "Disabled", "false"), f"MFA Delete disabled on S3 bucket {bucket}" + BY_ACTOR, "HIGH", **actor),
        e.rule("aws_s3_object_lock_disabled", ok & ((e.named("PutObjectLockConfiguration") & (~e.has(lock) | e.among(lock, "Disabled", ""))) | (e.named("PutBucketVersioning") & e.eq(mfa_delete, "Disabled"))), f"S3 {{$action}} for bucket {bucket}" + BY, "HIGH", action=F.when(name == "PutObjectLockConfiguration", "Object Lock disabled").otherwise("MFA Delete disabled")),
        e.rule("aws_s3_public_access_block_deleted", ok & e.named("DeleteBucketPublicAccessBlock"), f"S3 public access block deleted on bucket {bucket}" + BY_ACTOR, "HIGH", **actor),
        e.rule("aws_s3_ransomware_note_upload", ok & e.named("PutObject") & looks_like_ransom_note(note, (*RANSOM_NOTES, README_NOTE)), f"Potential ransomware note [{{$note}}] uploaded to S3 bucket {bucket}" + BY_ACTOR, "HIGH", note=note, **actor),
        e.rule("aws_s3_replication_deleted", ok & e.named("DeleteBucketReplication"), f"S3 bucket replication deleted on {bucket}" + BY_ACTOR, "MEDIUM", **actor),
        e.rule("aws_s3_versioning_suspended", ok & e.named("PutBucketVersioning") & e.among(rp + "VersioningConfiguration.Status", "Suspended", "Disabled"), f"S3 bucket versioning suspended on {bucket}" + BY_ACTOR, "HIGH", **actor),
        e.rule("aws_ssm_send_command", ok & e.named("SendCommand"), "SSM Run Command [{requestParameters.documentName|UNKNOWN}] executed on [{$targets}]" + BY, "HIGH", targets=F.when(targets > 0, F.concat(targets.cast("string"), F.lit(" instance(s)"))).otherwise("target(s)")),
        e.rule("aws_ssm_session_started", ok & e.named("StartSession"), "SSM Session started on [{requestParameters.target|UNKNOWN}]" + BY, "MEDIUM"),
        e.rule("aws_unauthorized_api_call", e.among("errorCode", "AccessDenied", "UnauthorizedOperation", "Client.UnauthorizedOperation"), "Unauthorized {eventName|UNKNOWN} attempted" + BY, "LOW"),
        e.rule("aws_vpc_flow_logs_disabled", ok & e.named("DeleteFlowLogs"), "VPC Flow Logs [{$flows}] deleted" + BY, "HIGH", flows=flows),
    ]


# Exposing actions by weight, policies that give everything, and agents of automation.
CRITICAL_EXPOSURE = (
    "s3:PutBucketPolicy s3:PutBucketAcl s3:PutBucketPublicAccessBlock s3:PutAccountPublicAccessBlock s3:DeleteBucketPolicy ec2:ModifySnapshotAttribute ec2:DisableImageBlockPublicAccess kms:PutKeyPolicy "
    "kms:CreateGrant iam:UpdateAssumeRolePolicy iam:CreateRole iam:CreatePolicy iam:CreatePolicyVersion lambda:AddPermission sns:AddPermission sns:SetTopicAttributes sqs:AddPermission sqs:SetQueueAttributes "
    "ecr:SetRepositoryPolicy secretsmanager:PutResourcePolicy glue:PutResourcePolicy lakeformation:PutDataLakeSettings ram:CreateResourceShare ram:AssociateResourceShare"
).split()
HIGH_EXPOSURE = (
    "s3:PutObjectAcl s3:PutAccessPointPolicy ec2:ModifyVpcEndpointServicePermissions ec2:CreateNetworkInterfacePermission lambda:AddLayerVersionPermission ssm:ModifyDocumentPermission "
    "es:UpdateElasticsearchDomainConfig es:CreateElasticsearchDomain elasticfilesystem:PutFileSystemPolicy glacier:SetVaultAccessPolicy logs:PutResourcePolicy backup:PutBackupVaultAccessPolicy "
    "codeartifact:DeleteDomainPermissionsPolicy codeartifact:DeleteRepositoryPermissionsPolicy codebuild:PutResourcePolicy sso:CreatePermissionSet sso:UpdatePermissionSet"
).split()
ADMIN_POLICIES = ("arn:aws:iam::aws:policy/AdministratorAccess", "arn:aws:iam::aws:policy/IAMFullAccess", "arn:aws:iam::aws:policy/PowerUserAccess")
AUTOMATION_AGENTS = ("Terraform", "CloudFormation", "aws-sdk-go", "Boto3")
IDENTITY_PROVIDER_CALLS = ("CreateSAMLProvider", "UpdateSAMLProvider", "DeleteSAMLProvider", "CreateOpenIDConnectProvider", "DeleteOpenIDConnectProvider", "AddClientIDToOpenIDConnectProvider", "RemoveClientIDFromOpenIDConnectProvider")


def aws_iam(e: Event) -> list[Rule]:
    rp = "requestParameters."
    no_error = e.s("errorCode", "") == ""
    act = aws.action(e.s("eventSource"), e.s("eventName"))
    of = lambda *names: F.coalesce(e.first_true(*(rp + n for n in names)), F.lit("unknown"))
    risky_target = of("userName", "roleName", "groupName", "policyArn", "policyName")
    target = of("userName", "roleName", "groupName", "policyArn")
    resource = of("bucketName", "functionName", "topicArn", "queueUrl", "keyId", "repositoryName", "roleName", "policyArn", "domainName", "resourceShareArn", "fileSystemId", "vaultName", "snapshotId")
    provider = of("name", "sAMLProviderArn", "openIDConnectProviderArn")
    role_account = F.get(F.split(e.s(rp + "roleArn", ""), ":"), F.lit(4))
    caller = e.s("recipientAccountId", "")
    risky = (aws.escalates_privileges(act) | aws.exposes_credentials(act)) & act.startswith("iam:")
    risk_level = F.when(act.isin("iam:CreateUser", "iam:CreateRole", "iam:CreateAccessKey", "iam:CreateLoginProfile", "iam:UpdateAssumeRolePolicy", "iam:PassRole"), "HIGH").when(act.startswith("iam:Delete"), "MEDIUM").otherwise("INFO")
    escalation = F.when(e.among(rp + "policyArn", *ADMIN_POLICIES) | act.isin("iam:PassRole", "iam:UpdateAssumeRolePolicy", "iam:CreatePolicyVersion"), "CRITICAL").when(act.startswith("iam:Attach") | act.startswith("iam:Put"), "HIGH").otherwise("MEDIUM")
    exposure = F.when(act.isin(*CRITICAL_EXPOSURE), "CRITICAL").when(act.isin(*HIGH_EXPOSURE), "HIGH").otherwise("MEDIUM")
    root_level = F.when(e.starts("eventName", "Create", "Delete", "Put"), "CRITICAL").when(e.starts("eventName", "Update", "Modify"), "HIGH").otherwise("MEDIUM")
    saml_level = F.when(e.starts("eventName", "Create"), "HIGH").when(e.starts("eventName", "Delete"), "CRITICAL").otherwise("MEDIUM")
    by = " by {userIdentity.arn|unknown}"
    return [
        e.rule("aws_iam_assume_role_cross_account", e.named("AssumeRole") & no_error & (caller != "") & (F.coalesce(role_account, F.lit("")) != "") & (caller != role_account), "Cross-account AssumeRole to {requestParameters.roleArn|unknown}" + by, "INFO", "{requestParameters.roleArn|}"),
        e.rule("aws_iam_high_risk_action", no_error & risky & ~e.contains_ci("userAgent", AUTOMATION_AGENTS), "High-risk IAM action: {$act} on {$target}" + by, risk_level, "{$act}:{$target}", act=act, target=risky_target),
        e.rule("aws_iam_mfa_deactivated", e.named("DeactivateMFADevice", "DeleteVirtualMFADevice") & no_error, "MFA {eventName|unknown} for {requestParameters.userName|unknown}" + by, "HIGH", "{requestParameters.userName|}"),
        e.rule("aws_iam_privilege_escalation", no_error & aws.escalates_privileges(act), "Privilege escalation: {$act} on {$target}" + by, escalation, "{$act}:{$target}", act=act, target=target),
        e.rule("aws_iam_resource_exposure", no_error & aws.exposes_resources(act), "Resource exposure: {$act} on {$resource}" + by, exposure, "{$act}:{$resource}", act=act, resource=resource),
        e.rule("aws_iam_root_activity", e.eq("userIdentity.type", "Root") & ~e.named("ConsoleLogin"), "Root account activity: {eventName|unknown}", root_level, "{eventName|}"),
        e.rule("aws_iam_saml_provider_modified", e.named(*IDENTITY_PROVIDER_CALLS) & no_error, "Identity provider modified: {eventName|unknown} on {$provider}" + by, saml_level, "{eventName}:{$provider}", provider=provider),
    ]


def aws_s3(e: Event, intended: bool = False, auth_buckets: tuple[str, ...] = ()) -> list[Rule]:
    objects = e.search("operation", r"REST\..*\.OBJECT") if intended else e.contains_ci("operation", ["REST.*.OBJECT"])
    cipher = e.truthy("cipherSuite") | e.truthy("ciphersuite") if intended else e.truthy("ciphersuite")
    return [
        e.rule("aws_s3_access_error", ~e.starts("userAgent", "aws-internal") & objects & F.coalesce(e.n("httpStatus").isin(403, 405), F.lit(False)), "{httpStatus|UNKNOWN} errors found to S3 Bucket [{bucket|<UNKNOWN_BUCKET>}]", "INFO"),
        e.rule("aws_s3_insecure_access", objects & (~cipher | ~e.truthy("tlsVersion")), "Insecure access to S3 Bucket [{bucket|<UNKNOWN_BUCKET>}]", "LOW"),
        e.rule("aws_s3_unauthenticated_access", e.among("bucket", *auth_buckets) & ~e.truthy("requester"), "Unauthenticated access to S3 Bucket [{bucket|<UNKNOWN_BUCKET>}]", "MEDIUM"),
    ]


def aws_vpcflow(e: Event, v6: bool = False) -> list[Rule]:
    port = F.coalesce(e.n("dstPort"), e.n("dstport"))
    source, target = F.coalesce(e.first_true("srcAddr"), e.s("srcaddr")), F.coalesce(e.first_true("dstAddr"), e.s("dstaddr"))
    outside, inside = F.coalesce(net.is_global(source, v6), F.lit(False)), F.coalesce(~net.is_global(target, v6), F.lit(False))
    local, public = F.coalesce(~net.is_global(source, v6), F.lit(False)), F.coalesce(~net.is_private(target, v6), F.lit(False))
    named = {"source": source, "target": target, "port": F.coalesce(e.s("dstPort"), e.s("dstport"))}
    return [
        e.rule("aws_vpc_inbound_traffic_port_blocklist", port.isin(22, 3389) & outside & inside, "Inbound traffic to blocklisted port {$port|UNKNOWN} from external IP to {$target|UNKNOWN}", "MEDIUM", **named),
        e.rule("aws_vpc_ssh_allowed_signal", (port == 22) & e.eq("action", "ACCEPT") & outside & inside, "SSH access from external IP {$source|UNKNOWN} to internal resource {$target|UNKNOWN}", "HIGH", **named),
        e.rule("aws_vpc_unapproved_outbound_dns", port.isin(53, 5353) & local & public & ~target.isin("1.1.1.1", "8.8.8.8"), "Unapproved outbound DNS traffic from {$source|UNKNOWN} to {$target|UNKNOWN}", "MEDIUM", **named),
    ]
