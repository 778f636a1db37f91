"""Column functions over detection phrases and ``x1, y1, x2, y2`` boxes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Phrase fragments per class, tested in this order.
CLASS_FRAGMENTS = (
    ("chair", ("chair",)),
    ("waste_bin", ("waste bin", "trash bin", "wastebasket", "bin")),
    ("box", ("box",)),
)


def canonical_class(phrase: Column) -> Column:
    """chair, waste_bin, box or null."""
    cleaned = F.replace(F.lower(F.trim(phrase)), F.lit("_"), F.lit(" "))
    result = None
    for name, fragments in CLASS_FRAGMENTS:
        found = F.lit(False)
        for fragment in fragments:
            found = found | F.contains(cleaned, F.lit(fragment))
        result = F.when(found, name) if result is None else result.when(found, name)
    return result


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """Box limited to the image; null when nothing is left."""
    limits = (width, height, width, height)
    corners = [
        F.least(F.greatest(F.element_at(box, i + 1), F.lit(0.0)), limit.cast("double"))
        for i, limit in enumerate(limits)
    ]
    kept = (corners[2] > corners[0]) & (corners[3] > corners[1])
    return F.when(kept, F.array(*corners))


def area(box: Column) -> Column:
    e = lambda i: F.element_at(box, i)
    return F.greatest(F.lit(0.0), e(3) - e(1)) * F.greatest(F.lit(0.0), e(4) - e(2))


def box_iou(a: Column, b: Column) -> Column:
    x, y = (lambda i: F.element_at(a, i)), (lambda i: F.element_at(b, i))
    inter = F.greatest(F.lit(0.0), F.least(x(3), y(3)) - F.greatest(x(1), y(1))) * F.greatest(
        F.lit(0.0), F.least(x(4), y(4)) - F.greatest(x(2), y(2))
    )
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def crop_box(box: Column, width: Column, height: Column, padding: float = 0.08) -> Column:
    """Whole-pixel box padded by a share of its size and clamped to the image."""
    e = lambda i: F.element_at(box, i)
    px, py = (e(3) - e(1)) * padding, (e(4) - e(2)) * padding
    return F.array(
        F.greatest(F.lit(0), (e(1) - px).cast("int")),
        F.greatest(F.lit(0), (e(2) - py).cast("int")),
        F.least(width.cast("int"), (e(3) + px).cast("int")),
        F.least(height.cast("int"), (e(4) + py).cast("int")),
    )


def normalized_box(box: Column, width: Column, height: Column) -> Column:
    e = lambda i: F.element_at(box, i)
    w, h = F.greatest(F.lit(1), width), F.greatest(F.lit(1), height)
    return F.array(e(1) / w, e(2) / h, e(3) / w, e(4) / h)


def visibility_status(frame_count: Column, visible: Column) -> Column:
    half = F.greatest(F.lit(1), F.floor(frame_count / 2))
    return (
        F.when(visible == 0, "not_visibly_confirmed")
        .when(visible == frame_count, "supported")
        .when(visible >= half, "partially_visible")
        .otherwise("unclear")
    )


def evidence_quality(score: Column, mask_score: Column, point_count: Column) -> Column:
    points = F.least(
        F.lit(1.0),
        F.log1p(F.greatest(F.lit(0), point_count).cast("double")) / F.log1p(F.lit(500.0)),
    )
    return score * mask_score * (F.lit(0.5) + F.lit(0.5) * points)


def association_status(score: Column) -> Column:
    return (
        F.when(score >= 0.70, "likely_same").when(score >= 0.50, "possible_match").otherwise("uncertain")
    )


def movement_status(score: Column, distance: Column) -> Column:
    moved = (score >= 0.70) & distance.isNotNull() & (distance > 0.5)
    return F.when(moved, "possible_movement").otherwise("not_established")


def mask_warnings(fraction: Column) -> Column:
    tags = F.array(
        F.when(fraction < 0.001, "tiny_mask"), F.when(fraction > 0.60, "large_mask")
    )
    return F.filter(tags, lambda tag: tag.isNotNull())
