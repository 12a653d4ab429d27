"""Answers for a demo customer: another customer's fleet under invented identities.

The vessels of a mapping stay under new names and numbers, listed vessels that do not
exist are made from the first one, and positions move by a repeatable amount.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.times import Moment
from wakeline.operators.deident import (
    clone_template,
    jitter,
    pseudonymise,
    rewrite_image_path,
    template_row,
)

# By how many tenths of a degree and seconds positions move, for
# vessels that exist and for made ones.
REAL_MOVES = (10, 10, 9 * 60)
MADE_MOVES = (25, 110, 4 * 3600)


@dataclass(frozen=True)
class DemoCustomer:
    """Who is shown as whom.

    ``mapping`` has a row per real ``imo`` with ``new_name, new_imo, new_mmsi``;
    ``identities`` lists the made vessels as (IMO, MMSI, name). ``source`` is the
    customer whose fleet is shown; None: every customer's.
    """

    name: str
    mapping: DataFrame
    identities: Sequence[tuple[int, int, str]]
    source: str | None = None
    real_type: str = "offshore"
    made_type: str = "merchant"
    seed: int = 42


def _moved(
    frame: DataFrame, as_of: Moment, seed: int, moves: tuple[int, int, int], key: str
) -> DataFrame:
    """The record ``position`` moved; a vessel without one starts from 0, 0."""
    fields = ("timestamp", "lat", "long", "direction")
    flat = frame.select(*[c for c in frame.columns if c != "position"], "position.*")
    return (
        jitter(flat, as_of, seed, *moves, key=key)
        .withColumn("position", F.struct(*fields))
        .drop(*fields)
        .select(*frame.columns)
    )


def demo_vessels(listed: DataFrame, demo: DemoCustomer) -> DataFrame:
    """F2's list for the demo customer, with its folder in image paths."""
    real = rewrite_image_path(pseudonymise(listed, demo.mapping, demo.name), demo.name)
    made = clone_template(template_row(listed), demo.name, demo.identities)
    return real.select(*listed.columns).unionByName(made.select(*listed.columns))


def demo_kpis(kpis: DataFrame, demo: DemoCustomer, as_of: Moment) -> DataFrame:
    """F1's rows for the demo customer, with its name and the fleet type."""
    labelled = kpis.withColumns({c: F.lit(None).cast("string") for c in ("company_id", "fleet_type")})
    real = pseudonymise(labelled, demo.mapping, demo.name, demo.real_type).select(*labelled.columns)
    made = clone_template(template_row(labelled), demo.name, demo.identities, demo.made_type)
    made = made.select(*labelled.columns)
    return _moved(real, as_of, demo.seed, REAL_MOVES, "vessel_id").unionByName(
        _moved(made, as_of, demo.seed, MADE_MOVES, "imo")
    )


def demo_positions(folded: DataFrame, demo: DemoCustomer, as_of: Moment) -> DataFrame:
    """P6's rows for the demo customer: mapped vessels under their own names, moved, and made ones."""
    real = folded.join(demo.mapping.select("imo"), "imo", "left_semi").select(*folded.columns)
    kept = ["mmsi", "fleet_type"]
    own = template_row(folded).withColumnsRenamed({c: f"own_{c}" for c in kept})
    # Made vessels get a name and an IMO number; the rest is the first vessel's.
    made = (
        clone_template(own, demo.name, demo.identities)
        .withColumnsRenamed({f"own_{c}": c for c in kept})
        .select(*folded.columns)
    )
    return _moved(real, as_of, demo.seed, REAL_MOVES, "vessel_id").unionByName(
        _moved(made, as_of, demo.seed, MADE_MOVES, "imo")
    )
