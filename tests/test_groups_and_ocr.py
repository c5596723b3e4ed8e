"""Ordered groups in both plans, and reading order against a loop over blocks."""

import random

from pyspark.sql import functions as F

from factloom.operators import ocr
from factloom.operators.groups import OrderedGroups

BLOCKS = "image_id string, block_no bigint, box array<struct<x: double, y: double>>, text string, confidence double"


def corners(x, y, width, height):
    return [(x, y), (x + width, y), (x + width, y + height), (x, y + height)]


def images(seed, count=40, hot=0):
    rng = random.Random(seed)
    rows = []
    for image in range(count):
        for number in range(hot if image == 0 and hot else rng.randrange(12)):
            box = corners(rng.randrange(50), rng.randrange(60) / 2, 10.0, rng.choice([0.5, 4.0, 9.0]))
            box = [(float(x), float(y)) for x, y in box]
            rows.append((f"i{image}", number, box, rng.choice([" w ", "x", "  ", "yz"]), rng.randrange(100) / 100))
    rng.shuffle(rows)
    return rows


def read_by_loop(rows):
    """Reading order of one image: walk down, open a line whenever the step is too big."""
    blocks = []
    for _, number, box, text, confidence in sorted(rows, key=lambda r: r[1]):
        if text.strip():
            ys = [y for _, y in box]
            blocks.append(((min(ys) + max(ys)) / 2, max(1.0, max(ys) - min(ys)), min(x for x, _ in box), number, text.strip()))
    blocks.sort(key=lambda b: b[0])
    lines = []
    for block in blocks:
        above = lines[-1][-1] if lines else None
        if above and abs(block[0] - above[0]) < max(above[1], block[1]) * 0.55:
            lines[-1].append(block)
        else:
            lines.append([block])
    return [b[3] for line in lines for b in sorted(line, key=lambda b: b[2])]


def orders(frame):
    found = {}
    for row in frame.collect():
        found.setdefault(row.image_id, []).append((row.reading_order, row.block_no))
    return {image: [number for _, number in sorted(pairs)] for image, pairs in found.items()}


def test_reading_order_matches_loop_in_both_plans(spark):
    rows = images(3, hot=400)
    frame = spark.createDataFrame(rows, BLOCKS)
    wanted = {}
    for image in {r[0] for r in rows}:
        order = read_by_loop([r for r in rows if r[0] == image])
        if order:
            wanted[image] = order
    assert orders(ocr.reading_order(frame)) == wanted
    assert orders(ocr.reading_order(frame, row_limit=60)) == wanted
    assert orders(ocr.reading_order(frame, row_limit=4)) == wanted


def test_documents_are_equal_in_both_plans(spark):
    frame = spark.createDataFrame(images(5, hot=300), BLOCKS)
    plain = sorted(ocr.documents(frame).collect())
    cut = sorted(ocr.documents(frame, row_limit=20).collect())
    assert [r.text for r in plain] == [r.text for r in cut]
    assert [tuple(r)[2:] for r in plain] == [tuple(r)[2:] for r in cut]


def test_golden_order_and_flags(spark):
    rows = [
        ("a", 0, corners(150.0, 100.0, 150.0, 20.0), "Line 2 Col 2", 0.90),
        ("a", 1, corners(10.0, 100.0, 130.0, 20.0), "Line 2 Col 1", 0.95),
        ("a", 2, corners(10.0, 20.0, 290.0, 20.0), "Line 1 Header", 0.99),
        ("b", 0, corners(0.0, 0.0, 5.0, 5.0), "low", 0.30),
        ("b", 1, corners(9.0, 0.0, 5.0, 5.0), "high", 0.60),
        ("c", 0, corners(0.0, 0.0, 5.0, 5.0), "  ", 0.9),
    ]
    documents = ocr.documents(spark.createDataFrame(rows, BLOCKS))
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    found = {r.image_id: tuple(r)[1:] for r in ocr.documents_for(listed, documents).collect()}
    assert found == {
        "a": ("Line 1 Header Line 2 Col 1 Line 2 Col 2", 0.9467, 3, []),
        "b": ("low high", 0.45, 2, ["low_average_ocr_confidence", "multiple_low_confidence_blocks"]),
        "c": ("", 0.0, 0, ["empty_ocr_result"]),
    }
    nested = ocr.blocks_in_order(ocr.reading_order(spark.createDataFrame(rows, BLOCKS)))
    blocks = {r.image_id: [b["text"] for b in r.blocks] for r in nested.collect()}
    assert blocks["a"] == ["Line 1 Header", "Line 2 Col 1", "Line 2 Col 2"]


def test_scans_over_cut_groups(spark):
    rng = random.Random(9)
    rows = [(0 if n % 3 == 0 else n % 50, n, rng.randrange(10)) for n in range(3000)]
    frame = spark.createDataFrame(rows, "k int, o int, v int").repartition(7)

    def scan(limit):
        groups = OrderedGroups.of(frame, ["k"], ["o"], limit)
        assert (len(groups.parts) == 2) == (limit < 1000)
        done = groups.position("p").previous({"last": "v"}).running_sum("s", F.col("v"))
        joined = done.join_text(F.col("v").cast("string"), ",", "t", "p", sum_v=F.sum("v"), max_o=F.max("o"))
        return sorted(tuple(r) for r in done.frame().select("k", "o", "p", "last", "s").collect()), sorted(
            tuple(r) for r in joined.collect()
        )

    assert scan(100) == scan(10_000)
    assert scan(100)[0][0][2:4] == (1, None)
