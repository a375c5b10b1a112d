"""Queries of the operators over text and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seston.llm.encode import encode_texts
from seston.llm.groups import describe_groups, object_groups
from seston.llm.leaks import leaks
from seston.llm.neighbours import exact_neighbours, neighbour_pairs, neighbours, recall
from seston.llm.objects import current_objects, usable
from seston.llm.stuffing import stuffed
from seston.llm.varied import inverse_density_sample, varied_sample
from seston.runtime import read, settle


SHAPE = ["eccentricity", "solidity", "elongation"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of objects of which at least one is among the 5 nearest of the other."""
    return neighbour_pairs(neighbours(current_objects(read(spark, sf_dir, "zoo_features"), SHAPE), SHAPE))


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the index against all rows, for the objects whose id is divisible by 100."""
    objects = settle(current_objects(read(spark, sf_dir, "zoo_features"), SHAPE), "objects")
    return recall(neighbours(objects, SHAPE), exact_neighbours(objects, objects.filter("roi_id % 100 = 0"), SHAPE))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that cover the variety of each planned sample."""
    objects = current_objects(read(spark, sf_dir, "zoo_features"), ["area", "circ"], "sample_id")
    return varied_sample(objects, read(spark, sf_dir, "pick_plan"), [F.log("area"), F.col("circ") * 4])


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand of all objects, drawn with chances inverse to density."""
    objects = current_objects(read(spark, sf_dir, "zoo_features"), ["area", "circ"])
    return inverse_density_sample(objects, 1000, [F.log("area"), F.col("circ") * 4])


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ["area", "major", "minor", "mean"]
    exemplars = read(spark, sf_dir, "exemplars")
    for c in measures:
        exemplars = exemplars.filter(usable(c))
    axes = [F.log("area"), F.log("major"), F.log("minor"), F.col("mean") * 4 / 255]
    return object_groups(current_objects(read(spark, sf_dir, "zoo_features"), measures), exemplars, axes)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that lie in a group, with its smallest exemplar."""
    return _groups(spark, sf_dir).select("roi_id", "exemplar_id")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exemplar, size, medoid and typical members of each group."""
    return describe_groups(_groups(spark, sf_dir), 4).drop("grp")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(read(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that take over a passage of the held-out items, with the item."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which most is keywords, links or tags."""
    return stuffed(read(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_recall": p1_recall, "p3_found": p3_found, "p3_sample": p3_sample, "p6_found": p6_found, "p6_groups": p6_groups, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}

SQL: dict[str, str] = {}
