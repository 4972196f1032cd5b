"""Event category from service and action, computed at read time and never stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# The category labels and the words that lead to them.
SENSITIVE_READ = "sensitive_read"
ROUTER_ACCESS = "router_access"
SECURITY_CHANGE = "security_change"
BUSINESS_MUTATION = "business_mutation"
SYSTEM = "system"

SECURITY_DOMAINS = (
    "authn", "authz", "sts", "role", "permission", "service_account",
    "session", "user", "security", "credentials",
)
SECURITY_VERBS = (
    "assign", "revoke", "rotate", "disable", "enable", "lock", "unlock", "merge", "link", "unlink",
)
BUSINESS_VERBS = (
    "create", "update", "delete", "cancel", "confirm", "redeem", "bootstrap", "change",
    "archive", "start", "stop", "purge", "reset", "resolve", "escalate",
)
READ_VERBS = ("read", "list", "view", "export", "download")


@dataclass(frozen=True)
class CategoryRules:
    """What differs between deployments: the gateway's name and where the trail is read."""

    gateway: str = "gateway"
    audit_read_prefix: str = "GET /admin/audit"


DEFAULT_RULES = CategoryRules()


def category_column(
    service: Column | str = "service",
    action: Column | str = "action",
    rules: CategoryRules = DEFAULT_RULES,
) -> Column:
    """One of five labels.

    The cheap tests come first: gateway rows and undotted actions never reach the pattern,
    which looks for a security domain in any dotted segment but the last.
    """
    service = F.col(service) if isinstance(service, str) else service
    action = F.col(action) if isinstance(action, str) else action
    dotted = F.instr(action, ".") > 0
    verb = F.substring_index(action, ".", -1)
    in_domain = action.rlike(r"(^|\.)(" + "|".join(SECURITY_DOMAINS) + r")\.")
    from_gateway = F.when(
        action.startswith(rules.audit_read_prefix), F.lit(SENSITIVE_READ)
    ).otherwise(F.lit(ROUTER_ACCESS))
    return (
        F.when(service == rules.gateway, from_gateway)
        .when(~dotted, F.lit(SYSTEM))
        .when(verb.isin(*SECURITY_VERBS) | in_domain, F.lit(SECURITY_CHANGE))
        .when(verb.isin(*BUSINESS_VERBS), F.lit(BUSINESS_MUTATION))
        .when(verb.isin(*READ_VERBS), F.lit(SENSITIVE_READ))
        .otherwise(F.lit(SYSTEM))
    )


def implied_service(category: str, service: Column, rules: CategoryRules = DEFAULT_RULES) -> Column | None:
    """A plain service predicate every row of `category` meets, for the Parquet scan.

    Labels other than the two the gateway can have exclude it; a NULL service (a row older
    than the column) is not the gateway.
    """
    if category == ROUTER_ACCESS:
        return service == rules.gateway
    if category in (SECURITY_CHANGE, BUSINESS_MUTATION, SYSTEM):
        return (service != rules.gateway) | service.isNull()
    return None
