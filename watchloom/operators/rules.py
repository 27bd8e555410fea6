"""Deterministic comparison of a subject with a match: the first rule that speaks decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import birth_years, impossible_age, year_gap


def gender_conflict(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    return (x != "") & (y != "") & (x != y)


def route(id_match: Column, genders: Column, gap: Column, impossible: Column, most_years: int = 10) -> Column:
    """``id``, ``gender``, ``dob``, ``temporal`` or ``review``."""
    return F.when(id_match, "id").when(genders, "gender").when(gap > most_years, "dob").when(impossible, "temporal").otherwise("review")


def compare(a_keys: Column, b_keys: Column, a_gender: Column, b_gender: Column, a_dobs: Column, b_dobs: Column, b_listed: Column) -> Column:
    ya, yb = birth_years(a_dobs), birth_years(b_dobs)
    return route(F.arrays_overlap(a_keys, b_keys), gender_conflict(a_gender, b_gender), year_gap(ya, yb), impossible_age(ya, b_listed))


def verdict(likely: Column, escalated: Column) -> Column:
    """Roll-up of a screening's decisions from two counts."""
    return F.when(likely > 0, "FLAG").when(escalated > 0, "ESCALATE").otherwise("CLEAR")
