"""Order-dependent JSON searches and signatures of webhook deliveries.

Built-in JSON functions don't keep the order of keys that the search depends on, and there is no built-in
HMAC, so both are vectorised Python functions.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def find_string(value: object, keys: tuple[str, ...], accept=bool) -> str | None:
    """The first accepted string under one of the keys: an object's own before those nested in it, depth first, in the order written."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                if k in keys and isinstance(x, str) and accept(x):
                    return x
            todo += reversed(list(v.values()))
        elif isinstance(v, list):
            todo += reversed(v)
    return None


def _date(text: str) -> bool:
    try:
        datetime.fromisoformat(text)
    except ValueError:
        return False
    return True


def _direct(record: object, keys: tuple[str, ...]) -> str | None:
    return next((record[k] for k in keys if isinstance(record.get(k), str) and record[k]), None) if isinstance(record, dict) else None


def purchase_of(body: str | None) -> tuple[str | None, str | None, str | None]:
    """(email, product id, expiry) of a delivery's body; nulls for what isn't there or no JSON."""
    try:
        payload = json.loads(body or "")
    except ValueError:
        return None, None, None
    data = payload["data"] if isinstance(payload, dict) and isinstance(payload.get("data"), dict) else payload
    ids = ("productId", "product_id")
    product = _direct(data, ids)
    if not product and isinstance(data, dict):
        product = _direct(data.get("product"), ("id", *ids))
        for one in data["products"] if not product and isinstance(data.get("products"), list) else []:
            product = product or _direct(one, ("id", *ids))
    product = product or find_string(data, ids)
    email = find_string(data, ("customerEmail", "customer_email", "email"), lambda s: "@" in s)
    return email, product, find_string(data, ("expiresAt", "expires_at", "currentPeriodEnd", "current_period_end"), _date)


def signature(secret: bytes, delivery: str, at: str, body: str) -> str:
    return base64.b64encode(hmac.new(secret, f"{delivery}.{at}.{body}".encode(), hashlib.sha256).digest()).decode()


def purchase(body: Column) -> Column:
    """``struct<email, product_id, expires_at>`` of a delivery's body."""

    @F.pandas_udf("email string, product_id string, expires_at string")
    def run(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([purchase_of(b) for b in bodies], columns=["email", "product_id", "expires_at"])

    return run(body)


def signed(secret: str, delivery: Column, at: Column, body: Column, header: Column) -> Column:
    """Whether one of a header's ``v1,signature`` candidates is right; the age of the delivery isn't looked at."""
    key = base64.b64decode(secret.removeprefix("whsec_")) if secret.startswith("whsec_") else secret.encode()

    @F.pandas_udf("boolean")
    def run(d: pd.Series, t: pd.Series, b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([any(hmac.compare_digest(signature(key, x, y, z), c.rpartition(",")[2]) for c in (w or "").split()) for x, y, z, w in zip(d, t, b, h)])

    return run(delivery, at, body, header)
