"""Builders of pipeline configurations: ``cnd`` for conditions, ``tf`` for transforms, ``rule`` for detect and alert."""

from __future__ import annotations

from typing import Any


def _made(kind: str, settings: dict) -> dict:
    return {"type": kind, "settings": {k: v for k, v in settings.items() if v is not None}}


def _object(source: str | None = None, target: str | None = None) -> dict:
    return {k: v for k, v in (("source_key", source), ("target_key", target)) if v is not None}


class cnd:  # noqa: N801
    """Conditions."""

    @staticmethod
    def all(*conditions: dict) -> dict:
        return _made("meta_all", {"conditions": list(conditions)})

    @staticmethod
    def any(*conditions: dict) -> dict:
        return _made("meta_any", {"conditions": list(conditions)})

    @staticmethod
    def none(*conditions: dict) -> dict:
        return _made("meta_none", {"conditions": list(conditions)})

    @staticmethod
    def contains(key: str, value: str) -> dict:
        return _made("string_contains", {"object": _object(key), "value": value})

    @staticmethod
    def equals(key: str, value: str) -> dict:
        return _made("string_equals", {"object": _object(key), "value": value})

    @staticmethod
    def starts_with(key: str, value: str) -> dict:
        return _made("string_starts_with", {"object": _object(key), "value": value})

    @staticmethod
    def ends_with(key: str, value: str) -> dict:
        return _made("string_ends_with", {"object": _object(key), "value": value})

    @staticmethod
    def match(key: str, pattern: str) -> dict:
        return _made("string_match", {"object": _object(key), "value": pattern})

    @staticmethod
    def eq(key: str, value: float) -> dict:
        return _made("number_equals", {"object": _object(key), "value": value})

    @staticmethod
    def gt(key: str, value: float) -> dict:
        return _made("number_greater_than", {"object": _object(key), "value": value})

    @staticmethod
    def lt(key: str, value: float) -> dict:
        return _made("number_less_than", {"object": _object(key), "value": value})

    @staticmethod
    def exists(key: str) -> dict:
        return _made("exists", {"object": _object(key)})

    @staticmethod
    def format_json() -> dict:
        return _made("format_json", {})


class tf:  # noqa: N801
    """Transforms."""

    @staticmethod
    def copy(source: str, target: str) -> dict:
        return _made("object_copy", {"object": _object(source, target)})

    @staticmethod
    def delete(key: str) -> dict:
        return _made("object_delete", {"object": _object(key)})

    @staticmethod
    def insert(key: str, value: Any) -> dict:
        return {"type": "object_insert", "settings": {"object": _object(target=key), "value": value}}

    @staticmethod
    def lower(key: str, target: str | None = None) -> dict:
        return _made("string_to_lower", {"object": _object(key, target or key)})

    @staticmethod
    def upper(key: str, target: str | None = None) -> dict:
        return _made("string_to_upper", {"object": _object(key, target or key)})

    @staticmethod
    def replace(key: str, pattern: str, replacement: str, target: str | None = None) -> dict:
        return _made("string_replace", {"object": _object(key, target or key), "pattern": pattern, "replacement": replacement})

    @staticmethod
    def switch(*cases: tuple[dict | None, list[dict]]) -> dict:
        """Cases of (condition, transforms); a condition of None is the default case."""
        return _made("meta_switch", {"cases": [{"condition": c or {}, "transforms": t} for c, t in cases]})

    @staticmethod
    def for_each(key: str, *transforms: dict) -> dict:
        return _made("meta_for_each", {"object": _object(key), "transforms": list(transforms)})

    @staticmethod
    def drop() -> dict:
        return _made("utility_drop", {})

    @staticmethod
    def control() -> dict:
        return _made("utility_control", {})

    @staticmethod
    def dns_reverse(key: str, target: str | None = None) -> dict:
        return _made("enrich_dns_reverse", {"object": _object(key, target)})

    @staticmethod
    def dns_forward(key: str, target: str | None = None) -> dict:
        return _made("enrich_dns_forward", {"object": _object(key, target)})

    @staticmethod
    def http_get(url: str, key: str | None = None, target: str | None = None, headers: dict | None = None, timeout: str | None = None) -> dict:
        return _made("enrich_http_get", {"object": _object(key, target), "url": url, "headers": headers, "timeout": timeout})

    @staticmethod
    def geoip(key: str, target: str | None = None) -> dict:
        return _made("enrich_geoip", {"object": _object(key, target)})

    @staticmethod
    def detect(id: str, condition: dict, title: str = "", description: str = "", severity: str = "INFO", tags: list[str] | None = None, dedup_key: str | None = None, threshold: int = 1) -> dict:
        return _made("detect", {"id": id, "condition": condition, "title": title, "description": description, "severity": severity, "tags": tags, "dedup_key": dedup_key, "threshold": threshold})

    @staticmethod
    def alert(*outputs: dict) -> dict:
        return _made("alert", {"outputs": list(outputs)})

    @staticmethod
    def stdout() -> dict:
        return _made("send_stdout", {})

    @staticmethod
    def slack(webhook_url: str, channel: str | None = None, username: str | None = None) -> dict:
        return _made("send_slack", {"webhook_url": webhook_url, "channel": channel, "username": username})

    @staticmethod
    def http_post(url: str, headers: dict | None = None, timeout: str | None = None) -> dict:
        return _made("send_http_post", {"url": url, "headers": headers, "timeout": timeout})


def rule(id: str, condition: dict, outputs: list[dict], **detect: Any) -> list[dict]:
    """Detect, then alert."""
    return [tf.detect(id, condition, **detect), tf.alert(*outputs)]


def pipeline(*transforms: dict) -> dict:
    return {"transforms": list(transforms)}
