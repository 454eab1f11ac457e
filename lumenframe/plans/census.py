"""Contact-spread census over all grown instances of a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import features, lattice, splitting
from lumenframe.operators.spatial import nearest
from lumenframe.params import DEFAULTS, Params
from lumenframe.session import cut

INST = features.INST


def contact_census(inst: DataFrame, maps, cases: DataFrame, kept: DataFrame, p: Params = DEFAULTS, link_mm: float = 12.0) -> DataFrame:
    """One row per contacted instance: spread, split gate, cluster cosine, nearest kept branch.

    ``inst`` and ``maps`` come from the detection plan, ``kept`` is its numbered landmark table.
    """
    parent = maps.cells.where("parent").select(*lattice.CELL)
    contact = cut(lattice.contact_cells(inst, parent), "census-contact")
    spread = features.contact_spread(contact, maps.grid)
    ostia = features.centroids(lattice.ostium_cells(contact, parent))
    mm = features.landmarks_mm(ostia.withColumns({f"seed_{c}": F.col(f"o{c}") for c in "zyx"}), cases).select(*INST, F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    mm = cut(mm, "census-ostia")
    near = nearest(mm, kept.select("case_id", F.col("instance_id").alias("kept_id"), F.col("x").alias("kx"), F.col("y").alias("ky"), F.col("z").alias("kz")), ["inst_id"], "kept_id", ["ox", "oy", "oz"], ["kx", "ky", "kz"], cutoff=link_mm)
    near = near.select(*INST, "kept_id", "dist_mm")
    cosines, _ = splitting.ridge_clusters(contact, inst, maps.grid, p)
    sizes = inst.groupBy(*INST).agg(F.count(F.lit(1)).alias("n_instance"))
    j = spread.join(mm, INST).join(sizes, INST).join(near, INST, "left").join(cosines, INST, "left")
    own = F.concat(F.lit("id"), F.col("inst_id").cast("string"))
    over = F.col("contact_spread_mm") >= p.split_min_spread_mm
    return j.select(
        "case_id", F.coalesce("kept_id", own).alias("instance_id"), own.alias("internal_id"), "contact_spread_mm",
        over.alias("over_18mm_threshold"), (over & F.col("cluster_cos").isNotNull()).alias("would_full_split"), "cluster_cos",
        "n_contact", "n_instance", F.col("ox").alias("ostium_x"), F.col("oy").alias("ostium_y"), F.col("oz").alias("ostium_z"),
        F.col("kept_id").alias("nearest_kept"), F.col("dist_mm").alias("kept_ostium_err_mm"),
    )
