import hashlib
import random
import re

from pyspark.sql import functions as F

from lodestrata.functions import text as tf

ALPHABET = ["a", "B", "ß", "É", "9", " ", "\t", "\n", "\x0b", "\x1c", "\x1f", " ", " ", "　", "-", "_", "!", "漢", "ſ"]


def strings(n=400):
    rng = random.Random(1)
    return ["", " ", *("".join(rng.choice(ALPHABET) for _ in range(rng.randrange(20))) for _ in range(n))]


def test_labels_and_terms_match_python(spark):
    df = spark.createDataFrame([(s,) for s in strings()], "s string")
    for r in df.select("s", tf.normalize_label(F.col("s")).alias("label"), tf.seed_terms(F.col("s")).alias("terms")).collect():
        assert r.label == " ".join(r.s.lower().split())
        words = "".join(c if c.isalnum() or c.isspace() else " " for c in r.s).lower().split()
        assert r.terms == (list(dict.fromkeys(words))[:3] or ["core"])


def test_ids_votes_tokens_and_overlap(spark):
    rows = [(s, t) for s, t in zip(strings(), reversed(strings()))]
    df = spark.createDataFrame(rows, "s string, t string")
    s, t = F.col("s"), F.col("t")
    got = df.select("s", "t", tf.stable_id("x", s, t).alias("id"), tf.hash_vote(s, "critic_a").alias("vote"), tf.overlap(tf.token_set(s), tf.token_set(t)).alias("o")).collect()
    for r in got:
        assert r.id == "x-" + hashlib.sha1(f"{r.s}::{r.t}".encode()).hexdigest()[:12]
        assert r.vote == ("reject" if hashlib.sha1(f"critic_a::{r.s}".encode()).digest()[0] % 2 else "accept")
        a, b = (set(re.findall("[a-z0-9]+", x.lower())) for x in (r.s, r.t))
        assert r.o == (len(a & b) / min(len(a), len(b)) if a and b else 0.0)


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "s string")
    r = df.select(tf.token_set(F.col("s")).alias("t"), tf.hash_vote(F.col("s"), "c").alias("v")).first()
    assert r.t == [] and r.v in ("accept", "reject")
