"""Opaque cursors, signed page tokens and pages of a pinned generation."""

import base64
import hashlib
import hmac
import json

from pyspark.sql import DataFrame

from cadastra.functions.canonical import canonical
from cadastra.operators.journal import change_page, keyset_page


class BootstrapRequired(KeyError):
    """The cursor is of another epoch or before the floor; a reader must begin with a snapshot."""


def encode(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def decode(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def cursor(instance: str, epoch: str, seq: int) -> str:
    return encode(canonical({"catalog_instance_id": instance, "epoch": epoch, "seq": seq}).encode())


def read_cursor(text: str, instance: str, epoch: str, floor: int, head: int) -> int:
    """The seq of a cursor; ValueError if it is malformed, of another instance or ahead, BootstrapRequired if it is too old."""
    try:
        value = json.loads(decode(text))
        found, its_epoch, seq = value["catalog_instance_id"], value["epoch"], int(value["seq"])
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("malformed cursor") from error
    if found != instance or seq < 0:
        raise ValueError("cursor of another instance")
    if its_epoch != epoch or seq < floor:
        raise BootstrapRequired("bootstrap_required")
    if seq > head:
        raise ValueError("cursor ahead of the journal")
    return seq


def sign(value: dict, secret: bytes) -> str:
    """A page token: the value and its HMAC-SHA256."""
    body = canonical(value).encode()
    return encode(body) + "." + encode(hmac.new(secret, body, hashlib.sha256).digest())


def verify(token: str, secret: bytes) -> dict:
    body, _, mark = token.partition(".")
    try:
        raw, signature = decode(body), decode(mark)
    except ValueError as error:
        raise ValueError("malformed token") from error
    if not hmac.compare_digest(signature, hmac.new(secret, raw, hashlib.sha256).digest()):
        raise ValueError("token not signed here")
    return json.loads(raw)


def snapshot_page(rows: DataFrame, keys: list[str], token: str | None, secret: bytes, limit: int = 500) -> tuple[list, str | None]:
    """(rows, token of the next page or None) of a pinned snapshot in order of `keys`; at most `limit` rows reach the driver."""
    after = tuple(verify(token, secret)["after"]) if token else None
    found = keyset_page(rows, keys, after, limit).collect()
    more = len(found) > limit
    found = found[:limit]
    return found, sign({"after": [found[-1][k] for k in keys]}, secret) if more else None


def changes_after(journal: DataFrame, text: str, instance: str, epoch: str, floor: int, head: int, limit: int = 500) -> tuple[list, str, bool]:
    """(changes, next cursor, whether there are more) after a cursor."""
    seq = read_cursor(text, instance, epoch, floor, head)
    found = change_page(journal, seq, min(max(1, limit), 1000), head).collect()
    last = found[-1]["seq"] if found else seq
    return found, cursor(instance, epoch, last), last < head
