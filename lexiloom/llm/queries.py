"""Queries of this subpackage, and the SQL to hold some of them against."""

from __future__ import annotations

from lexiloom.llm import encode, grouping, languages, leaks, overlap, responses
from lexiloom.plans.session import table


def _on(f, *names):
    return lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names])


QUERIES = {
    "p1_found": _on(overlap.p1_found, "parallel", "entity_redirects"),
    "p1_report": _on(overlap.p1_report, "parallel", "entity_redirects"),
    "p5_found": _on(grouping.p5_found, "parallel", "entity_redirects"),
    "p5_splits": _on(grouping.p5_splits, "parallel", "entity_redirects"),
    "p5_balance": _on(grouping.p5_balance, "parallel", "entity_redirects"),
    "p6_ids": _on(encode.p6_ids, "documents"),
    "p7_found": _on(leaks.leaked_items, "documents", "eval_items"),
    "p7_report": _on(leaks.p7_report, "documents", "eval_items"),
    "p2_found": _on(responses.p2_found, "flat", "entity_labels"),
    "p2_forms": _on(responses.p2_forms, "flat", "entity_labels"),
    "p4_found": _on(responses.response_defects, "flat", "entity_labels"),
    "p4_report": _on(responses.p4_report, "flat", "entity_labels"),
    "p8_found": _on(languages.p8_found, "documents", "eval_items"),
    "p8_labels": _on(languages.p8_labels, "documents", "eval_items"),
    "p8_segments": _on(languages.p8_segments, "documents", "eval_items"),
}


def _plain(c: str) -> str:
    """SQL: upper case, ASCII digits, nothing that isn't visible."""
    digits = "".join(chr(z + i) for z in (0xFF10, 0x660, 0x6F0, 0x9E6, 0x966) for i in range(10))
    return f"upper(regexp_replace(translate({c}, '{digits}ＱＰｑｐ｜', '{'0123456789' * 5}QPQP|'), '[\\s\\pZ\\pC]', '', 'g'))"


def _id(c: str, kind: str) -> str:
    return f"'{kind}' || nullif(regexp_extract({_plain(c)}, '^(?:.*[/:#<(\\[])?{kind}?0*([0-9]+)[>)\\]]?$', 1), '')"


def _part(i: int) -> str:
    pattern = "^(?:FACT:)?<?(?:[A-Z]*:)?Q?0*([0-9]+)>?[|/_;,]+<?(?:[A-Z]*:)?P?0*([0-9]+)>?[|/_;,]+<?(?:[A-Z]*:)?Q?0*([0-9]+)>?(?:#.*)?$"
    return f"'{' QPQ'[i]}' || nullif(regexp_extract({_plain('fact_id')}, '{pattern}', {i}), '')"


_REDIRECTS = f"""r as (select {_id('old_id', 'Q')} as a, {_id('new_id', 'Q')} as b from entity_redirects),
 chain as (select a, b from r where a <> b union select chain.a, r.b from chain join r on chain.b = r.a), last as (select a, b from chain where b not in (select a from r))"""
_FACTS = f"""with recursive {_REDIRECTS}, f as (select row_id, split, source, coalesce({_id('subject_id', 'Q')}, {_part(1)}) as s0, coalesce({_id('property_id', 'P')}, {_part(2)}) as p, coalesce({_id('object_id', 'Q')}, {_part(3)}) as o0 from parallel),
 g as (select row_id, split, source, coalesce(x.b, s0) as s, p, coalesce(y.b, o0) as o from f left join last x on s0 = x.a left join last y on o0 = y.a)"""
_GROUPS = f"""with recursive {_REDIRECTS}, f as (select row_id, {_id('subject_id', 'Q')} as a, {_part(1)} as b from parallel), e as (select a, b from f where a <> b union select a, b from r where a <> b),
 sides as (select a, b from e union select b, a from e), reach as (select a, b from sides union select reach.a, sides.b from reach join sides on reach.b = sides.a),
 label as (select a, least(a, min(b)) as label from reach group by a), g as (select row_id, coalesce(label, f.a, f.b) as g from f left join label on label.a = coalesce(f.a, f.b)),
 m as (select g, min(row_id) as row_a from g where g is not null group by g)"""
ORACLES = {
    "p1_found": _FACTS + " select least(x.row_id, y.row_id) as row_a, greatest(x.row_id, y.row_id) as row_b from g x join g y using (s, p, o) where x.split = 'train' and y.split in ('validation', 'test')",
    "p1_report": _FACTS + """, h as (select y.row_id, count(*) as n from g x join g y using (s, p, o) where x.split = 'train' and y.split in ('validation', 'test') group by 1)
 select p.split, p.source, count(*) as n_rows, count(h.row_id) as n_leaked, coalesce(sum(h.n), 0)::bigint as n_pairs from parallel p left join h on p.row_id = h.row_id where p.split in ('validation', 'test') group by 1, 2""",
    "p5_found": _GROUPS + " select row_a, row_id as row_b from g join m using (g) where row_id <> row_a",
}
