"""Names of classes and splits."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def normalised(name: Column) -> Column:
    """Spelling variants of one class fold together: case, spaces, hyphens, underscores, a plural s."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"[\s_-]+", "")
    plural = (F.length(bare) > 3) & bare.endswith("s") & ~bare.endswith("ss")
    return F.when(plural, bare.substr(F.lit(1), F.length(bare) - 1)).otherwise(bare)


def normalise_name(name: str) -> str:
    bare = re.sub(r"[\s_-]+", "", name.strip().lower())
    return bare[:-1] if len(bare) > 3 and bare.endswith("s") and not bare.endswith("ss") else bare


def role(split: Column) -> Column:
    low = F.lower(split)
    return F.when(low.isin(*vocab.TRAIN_NAMES), "train").when(low.isin(*vocab.VAL_NAMES), "val").otherwise("other")
