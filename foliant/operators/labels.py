"""Cluster labels from cleaned shelf tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.shelves import AGE_DISPLAYS, GENERIC_DISPLAYS, clean_shelves, display, generic_factor, shelf_weight


def shelf_scores(members: DataFrame) -> DataFrame:
    """cluster_id, shelf and score; a repeated tag of one book counts each time. members: cluster_id, cluster_rank, popular_shelves."""
    tags = members.select("cluster_id", shelf_weight(F.col("cluster_rank")).alias("w"), F.explode(clean_shelves(F.col("popular_shelves"))).alias("shelf"))
    return tags.groupBy("cluster_id", "shelf").agg(F.sum("w").alias("score"))


def label_scores(members: DataFrame) -> DataFrame:
    """cluster_id, name, raw and penalised score, and place among the cluster's names."""
    named = shelf_scores(members).groupBy("cluster_id", display(F.col("shelf")).alias("name")).agg(F.sum("score").alias("raw"))
    named = named.withColumn("score", F.col("raw") * generic_factor(F.col("name")))
    return named.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("score"), F.desc("raw"), "name")))


def pick(names: list[str]) -> list[str]:
    """Three names that aren't generic; one generic one if there are fewer than two; of age names the first only."""
    chosen = [n for n in names if n not in GENERIC_DISPLAYS][:3]
    if len(chosen) < 2:
        chosen += [n for n in names if n in GENERIC_DISPLAYS][:1]
    return one_age(chosen)


def one_age(chosen: list[str]) -> list[str]:
    ages = [n for n in chosen if n in AGE_DISPLAYS]
    return [n for n in chosen if n not in ages[1:]]


def unique_labels(names: dict[int, list[str]]) -> dict[int, str]:
    """A label for each cluster, in order of id. One that is taken, as text or as a set of names, gets one of its 6 next names: each is tried in all slots, from the last on, before the next name is.
    If none helps, the label gets a suffix of as many I as are free, from two on. Without names: Neighborhood and the id."""
    taken: set = set()
    out = {}
    free = lambda chosen: " · ".join(chosen) not in taken and frozenset(chosen) not in taken
    for c in sorted(names):
        chosen = pick(names[c])
        if not chosen:
            out[c] = f"Neighborhood {c}"
            continue
        others = [n for n in names[c] if n not in chosen][:6]
        swapped = (one_age([*chosen[:i], other, *chosen[i + 1 :]]) for other in others for i in reversed(range(len(chosen))))
        best = next((t for t in ([chosen] if free(chosen) else swapped) if free(t)), None)
        label = " · ".join(best or chosen)
        if best:
            taken.add(frozenset(best))
        else:
            n = 2
            while f"{label} {'I' * n}" in taken:
                n += 1
            label = f"{label} {'I' * n}"
        taken.add(label)
        out[c] = label
    return out


def cluster_labels(members: DataFrame) -> DataFrame:
    """cluster_id and label. Names come to the driver: of each cluster the first 9, the first 9 that aren't generic and the first generic one, which are all that unique_labels() looks at."""
    ids = members.select("cluster_id").distinct()
    scored = label_scores(members).withColumn("generic", F.col("name").isin(sorted(GENERIC_DISPLAYS)))
    scored = scored.withColumn("own_place", F.row_number().over(Window.partitionBy("cluster_id", "generic").orderBy("place")))
    best = scored.where("place <= 9 or own_place <= if(generic, 1, 9)").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("n"))
    rows = ids.join(best, "cluster_id", "left").collect()
    labels = unique_labels({r["cluster_id"]: [x["name"] for x in r["n"] or []] for r in rows})
    return members.sparkSession.createDataFrame(sorted(labels.items()), "cluster_id int, label string")
