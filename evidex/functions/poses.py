"""Column functions over camera poses (flat row-major rotations, translations)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evidex.functions.vectors import dot, norm


def flatten_rotation(matrix: Column) -> Column:
    """The nine rotation entries of a nested 4x4 matrix."""
    return F.flatten(
        F.transform(F.slice(matrix, 1, 3), lambda row: F.slice(row, 1, 3))
    )


def translation_of(matrix: Column) -> Column:
    return F.transform(F.slice(matrix, 1, 3), lambda row: F.element_at(row, 4))


def yaw_rotation(yaw: Column) -> Column:
    """Rotation about the z axis, flat row-major."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(F.cos(yaw), -F.sin(yaw), zero, F.sin(yaw), F.cos(yaw), zero, zero, zero, one)


def _clip_cosine(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def rotation_error_deg(rotation_a: Column, rotation_b: Column) -> Column:
    """Geodesic angle: the trace of A'B is the sum of elementwise products."""
    return F.degrees(F.acos(_clip_cosine((dot(rotation_a, rotation_b) - 1.0) / 2.0)))


def translation_error_m(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def quaternion_angle_rad(a: Column, b: Column) -> Column:
    cosine = F.abs(dot(a, b) / (norm(a) * norm(b)))
    return F.lit(2.0) * F.acos(F.least(F.lit(1.0), cosine))


def is_camera_pose(convention: Column, matrix: Column) -> Column:
    """camera_to_world, 4x4 and finite."""
    finite = F.forall(
        F.flatten(matrix), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    square = (F.size(matrix) == 4) & F.forall(matrix, lambda row: F.size(row) == 4)
    return F.coalesce((convention == "camera_to_world") & square & finite, F.lit(False))
