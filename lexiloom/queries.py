"""Registry of the core queries, filled by the modules of lexiloom.plans."""

from __future__ import annotations

from lexiloom.operators import heavy_keys
from lexiloom.plans import analysis, cleaning, registry, release, reports, sampled  # noqa: F401  (fills the registry)
from lexiloom.plans.session import table

SPLITS = ("train", "validation", "test")

QUERIES = {
    "p3_found": lambda s, d: heavy_keys.heavy_keys(table(s, d, "parallel"), ["object_id", "relation"], 0.05),
    "p3_objects": lambda s, d: heavy_keys.key_profile(table(s, d, "parallel"), "object_id", "subject_id", "split", SPLITS),
    "p3_relations": lambda s, d: heavy_keys.key_profile(table(s, d, "parallel"), "relation", "subject_id", "split", SPLITS),
}
_PROFILE = """select {k} as key_value, count(*) as n_facts, count(distinct subject_id) as n_subjects,
 count(*) filter (where split = 'train') as n_train, count(*) filter (where split = 'validation') as n_validation,
 count(*) filter (where split = 'test') as n_test from parallel group by 1"""
ORACLES = {
    "p3_found": """with c as (select 'object_id' as field_name, object_id as key_value from parallel
 union all select 'relation', relation from parallel)
 select field_name, key_value from c where key_value is not null group by 1, 2
 having count(*) > (select count(*) from parallel) / 20.0""",
    "p3_objects": _PROFILE.format(k="object_id"),
    "p3_relations": _PROFILE.format(k="relation"),
}
QUERIES |= registry.QUERIES
ORACLES |= registry.ORACLES
