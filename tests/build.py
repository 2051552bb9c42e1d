"""Tiny hand-made inputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import types as T

from tallyroom import schema

AS_OF = datetime(2024, 1, 30, 12, 0, 0)



def _numbered(fields: T.StructType) -> T.StructType:
    """The table with plain numbers as ids."""
    return T.StructType([T.StructField("id", T.LongType()), *[f for f in fields if f.name != "id"]])


EVENTS, SUBSCRIPTIONS = _numbered(schema.EVENTS), _numbered(schema.SUBSCRIPTION_EVENTS)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def _rows(fields: T.StructType, rows: list[dict], defaults: dict) -> list[tuple]:
    out = []
    for i, row in enumerate(rows):
        unknown = set(row) - set(fields.names)
        assert not unknown, unknown
        full = {"id": i, **defaults, **row}
        out.append(tuple(full.get(name) for name in fields.names))
    return out


def events(spark, *rows: dict):
    """Rows give ``ts`` as text; the rest has defaults."""
    rows = [{**{k: v for k, v in r.items() if k != "ts"}, "event_ts": at(r["ts"])} for r in rows]
    defaults = dict(name="app_opened", category="engagement", properties="{}", device_id="d1",
                    platform="ios", session_duration_seconds=0)
    return spark.createDataFrame(_rows(EVENTS, rows, defaults), EVENTS)


def subscriptions(spark, *rows: dict):
    rows = [{**{k: v for k, v in r.items() if k != "ts"}, "created_at": at(r["ts"])} for r in rows]
    defaults = dict(event_type="INITIAL_PURCHASE", app_user_id="u1", environment="PRODUCTION")
    return spark.createDataFrame(_rows(SUBSCRIPTIONS, rows, defaults), SUBSCRIPTIONS)


def profiles(spark, *rows: dict):
    return spark.createDataFrame(_rows(schema.PROFILES, list(rows), {}), schema.PROFILES)


def changes(spark, *rows: dict):
    fields = T.StructType([*schema.PROFILES.fields, T.StructField("seq", T.LongType())])
    return spark.createDataFrame(_rows(fields, [{"seq": i, **r} for i, r in enumerate(rows)], {}), fields)


def lines(spark, *texts: str):
    return spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, seq long")


def dicts(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def only(df) -> dict:
    (row,) = dicts(df)
    return row
