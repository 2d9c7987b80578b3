"""A unit's kind and its asset's type as one number, so that a unit is a row of numbers.

Numbers group and shuffle in fewer bytes than the two names, which are put back at the end.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from trovelight.fixed_values import ASSET_TYPES, UNIT_KINDS

PAIRS = [(kind, asset_type) for kind in UNIT_KINDS for asset_type in ASSET_TYPES]


def unit_code(kind: Column, asset_type: Column) -> Column:
    """The number of a kind and a type; null for names that are not among the known ones."""
    code = None
    for number, (one_kind, one_type) in enumerate(PAIRS):
        here = (kind == one_kind) & (asset_type == one_type)
        code = F.when(here, number) if code is None else code.when(here, number)
    return code.cast("bigint")


def kind_of(code: Column) -> Column:
    return F.array(*[F.lit(kind) for kind, _ in PAIRS])[code.cast("int")]


def asset_type_of(code: Column) -> Column:
    return F.array(*[F.lit(asset_type) for _, asset_type in PAIRS])[code.cast("int")]
