"""Topics are matched over whole texts."""

from tidemark.registry import QUERIES

SUBJECTS = ["garden tomato harvest compost seedling", "engine piston gearbox throttle exhaust", "violin sonata orchestra cello melody"]


def test_topics_match_by_words_after_the_tenth(spark, tmp_path):
    letters = "abcdefghijklmnop"
    own = lambda i: " ".join("q" + letters[i // 16] + letters[i % 16] + x * 3 for x in letters[:10])  # noqa: E731  ten words of one text only
    rows = [(i, f"{own(i)} {SUBJECTS[i // 3 % 3]}", "en", "s", 0) for i in range(108)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["join_topic_match"](spark, str(tmp_path)).collect()
    assert sorted((r["pair"], r["similarity"]) for r in got) == [(p, 1.0) for p in (0, 0, 0, 1, 1, 1)]
    assert all(len({r[side] for r in got if r["pair"] == p}) == 3 for p in (0, 1) for side in "ab")


def test_best_similarity_without_a_threshold(spark):
    """Every bound and block size finds the best of all rows, as a loop over all pairs does."""
    import random
    import re
    import unicodedata

    from tidemark.operators.neardup import best_similarity

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [texts[0].upper() + "!", texts[1] + " " + words[0], "xyz xyz", "ção", None, "", "..."]

    def grams(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c))
        t = re.sub(r"\s+", " ", re.sub(r"(.)\1+", r"\1", re.sub(r"[^a-z0-9]+", " ", t))).strip()
        return {f" {t} "[i : i + 3] for i in range(len(t))} if t else set()

    sets = [grams(t) for t in texts]
    want = {i: max((len(sets[i] & s) / len(sets[i] | s) if sets[i] | s else 0.0) for j, s in enumerate(sets) if j != i and j % 2) for i in range(0, len(texts), 2)}
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for bounds, block in (((0.8, 0.6), 1024), ((), 7), ((0.3,), 5)):
        got = {r.id: r.similarity for r in best_similarity(d.where("id % 2 = 0"), d.where("id % 2 = 1"), bounds, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
