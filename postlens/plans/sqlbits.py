"""DuckDB fragments shared by the oracle twins (same semantics as the Column
helpers in ``postlens.functions``)."""

from __future__ import annotations

SKEY = "lower(coalesce(sentiment_label, 'neutral'))"
AKEY = ("(case when lower(trim(aspect_dominant)) = 'app_ux' then 'app/ux' "
        "else lower(trim(aspect_dominant)) end)")
ADISP = ("(case when lower(trim(coalesce(cast(aspect_dominant as varchar), ''))) in ('', 'none', 'unspecified') "
         "then 'Other' else trim(cast(aspect_dominant as varchar)) end)")
SENT_VALUES = "(values ('positive', 0), ('neutral', 1), ('negative', 2))"
ASPECT_VALUES = "(values ('pricing', 0), ('delivery', 1), ('returns', 2), ('staff', 3), ('app/ux', 4))"


def pct(n: str, total: str, digits: int | None) -> str:
    raw = f"100.0e0 * {n} / {total}"
    val = raw if digits is None else f"round({raw}, {digits})"
    return f"(case when {total} > 0 then {val} else 0.0e0 end)"


def counts3(key: str = SKEY) -> str:
    return ", ".join(f"count_if({key} = '{s}') as {s}" for s in ("positive", "neutral", "negative"))


def aspect_split_sql(bucket: str, labels: list[str], digits: int) -> str:
    vals = ", ".join(f"('{a}', {i})" for i, a in enumerate(labels))
    tot = "(positive + neutral + negative)"
    return f"""
c as (select {bucket} as aspect, {counts3()} from posts group by 1),
v as (select * from (values {vals}) v(aspect, ord)),
j as (select v.aspect, v.ord, cast(coalesce(c.positive, 0) as bigint) as positive,
        cast(coalesce(c.neutral, 0) as bigint) as neutral, cast(coalesce(c.negative, 0) as bigint) as negative
      from v left join c on v.aspect = c.aspect)
select *, {pct('positive', tot, digits)} as positive_pct, {pct('neutral', tot, digits)} as neutral_pct,
  {pct('negative', tot, digits)} as negative_pct from j
"""
