"""Tags by name and by code, typed."""

from pyspark.sql import functions as F

from rasterloom.functions import tags


def test_keys_and_types(spark):
    none = F.lit(None).cast(tags.KIND)
    t = tags.add(tags.add(tags.add(tags.add(none, "a", 1), 4, "4.5e1x"), "a", "word"), 4, 8)
    got = spark.range(1).select(
        tags.find(t, "a").alias("by_name"), tags.find(t, 4).alias("by_code"), tags.get_float(t, 4).alias("float"), tags.get_float(tags.delete_at(t, 0), "a").alias("word"),
        tags.get_float(t, "b").alias("missing"), tags.get_int(t, 4).alias("int"), F.size(tags.delete(t, 4)).alias("left"), F.size(tags.delete(t, "a")).alias("coded"), tags.find(tags.put(t, 4, "x"), 4).alias("put"),
        tags.get_float(tags.put_float(none, 1, 1 / 3), 1).alias("whole"), tags.get_float(tags.put_float(none, 1, 1 / 3, 3), 1).alias("three"), tags.get_float(tags.put_float(none, 1, F.lit(-2.7e-9), 0), 1).alias("tiny"),
        tags.get_colour(tags.put_colour(none, 2, 1, 2, 3, 4), 2).alias("colour"), tags.get(tags.put_colour(none, "c", 255, 0, 9), "c").alias("text"), F.size(tags.delete_at(t, 9)).alias("beyond"),
    ).first()
    assert got.by_name == ["1", "word"] and got.by_code == ["4.5e1x", "8"]
    assert (got.float, got.word, got.missing, got.int) == (45.0, 0.0, None, 4)
    assert (got.left, got.coded, got.put, got.beyond) == (2, 2, ["x"], 4)
    assert (got.whole, got.three, got.tiny) == (1 / 3, 0.333, -3e-9)
    assert tuple(got.colour) == (1, 2, 3, 4) and got.text == "color(255,0,9,255)"
