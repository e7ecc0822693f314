"""Schemas, status values and limits shared by all modules."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

PUT, DELETE = 0, 1
#: Results of a lookup: the newest version is a put, it is a tombstone, there is none.
FOUND, DELETED, NOT_FOUND = 0, 1, 2

LOG = "key string, value string, op int, seq long"
EDIT = ("next_table_id long, sequence_number long, "
        "new_files array<struct<id:long,level:int,size:long,smallest_key:string,largest_key:string>>, "
        "delete_files array<struct<id:long,level:int>>")

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30


@dataclass(frozen=True)
class Config:
    """Limits of a store.  ``checked`` enforces the ranges that a configuration file must keep."""

    memtable_bytes: int = 32 * MIB
    memtables_per_flush: int = 4
    block_bytes: int = 4 * KIB
    levels: int = 7
    level0_trigger: int = 6

    def checked(self) -> Config:
        ranges = {"memtable_bytes": (4 * MIB, GIB), "memtables_per_flush": (1, 16), "block_bytes": (4 * KIB, 32 * KIB),
                  "levels": (1, 7), "level0_trigger": (1, 8)}
        for field in fields(self):
            value, (low, high) = getattr(self, field.name), ranges[field.name]
            if not isinstance(value, int) or not low <= value <= high:
                raise ValueError(f"{field.name} must be between {low} and {high}, not {value!r}")
        return self


#: Names in a configuration file, by section; the other keys tune threads and
#: caches, which Spark manages, and are only checked.
_KEYS = {"LSM_PER_MEM_SIZE_LIMIT": "memtable_bytes", "MAX_IMMUTABLE_MEMTABLES_IN_MEMORY": "memtables_per_flush",
         "SST_BLOCK_SIZE": "block_bytes", "LSM_SST_NUM_LEVELS": "levels", "LVL0_COMPACTION_TRIGGER": "level0_trigger"}
_TUNING = {"TOTAL_BG_THREADS": (1, None), "TOTAL_TABLES_CACHE": (0, 1000), "TOTAL_BLOCKS_EACH_CACHE": (1, None),
           "TOTAL_BLOCKS_CACHE": (0, None)}


def load_config(text: str) -> Config:
    """A ``Config`` from TOML with the sections ``lsm`` and ``cache``; raises ValueError if it is not valid."""
    spec = tomllib.loads(text)
    given = {k: v for name in ("lsm", "cache") if isinstance(spec.get(name), dict) for k, v in spec[name].items()}
    missing = [k for k in (*_KEYS, *_TUNING) if k not in given]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    for k, (low, high) in _TUNING.items():
        if not isinstance(given[k], int) or given[k] < low or high is not None and given[k] > high:
            raise ValueError(f"{k} must be {low} or more" + (f" and at most {high}" if high else ""))
    return Config(**{name: given[k] for k, name in _KEYS.items()}).checked()
