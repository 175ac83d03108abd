"""Gates of the license scan save work only: labels with and without them agree for every rule."""

import re
from itertools import product

from tests.llm.test_operators import by_id, table
from tidemark.llm import license_scan
from tidemark.llm.license_rules import RULES


def spelled(tree) -> list[str]:
    """Texts that a pattern matches, with every alternative and both ends of each repeat and range."""
    every = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            some = [chr(arg)]
        elif op == "ANY":
            some = ["x"]
        elif op == "IN":
            some = [chr(x) for kind, a in arg for x in (a if str(kind) == "RANGE" else [a])]
        elif op == "BRANCH":
            some = [x for part in arg[1] for x in spelled(part)]
        elif op == "SUBPATTERN":
            some = spelled(arg[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            some = sorted({x * n for n in arg[:2] for x in spelled(arg[2])})
        else:
            assert op == "AT"
            some = [""]
        every = [a + b for a, b in product(every, some)]
    return every


def examples(pattern: str) -> list[str]:
    out = spelled(re._parser.parse(pattern))
    assert all(re.search(pattern, x) for x in out)
    return out


def test_every_match_holds_its_gates():
    for contexts, keywords, _, _, pattern in RULES:
        for x in examples(pattern):
            assert any(c in x for c in contexts) and any(k in x for k in keywords), (pattern, x)
            assert re.search(license_scan.PREFILTER, x) and re.search(license_scan.PREFILTER, x.upper().replace(" ", "\n * ")), x


def test_gated_and_ungated_labels_agree(spark, monkeypatch):
    texts = []
    for _, _, _, _, pattern in RULES:
        texts.append(f"“{min(examples(pattern), key=len)}” é")
    named = {
        "Licensed under GPLv3": "gpl-3.0", "released under LGPLv3": "lgpl-3.0", "Expat license": "mit", "SPDX-License-Identifier: BSL-1.0": "boost",
        "SPDX-License-Identifier: MS-PL": "ms-pl", "SPDX-License-Identifier: BUSL-1.1": "busl", "SPDX-License-Identifier: AFL-3.0": "afl",
        "Open Software License": "osl", "Universal Permissive License": "upl", "Server Side Public License": "sspl", "Q Public License": "qpl",
        "Distributed\n  under the zlib": "zlib", "put in the PUBLIC\n# DOMAIN": "public-domain", "_UPL_": "upl", "submit a couple of discussions": None,
    }
    texts = [*named, *dict.fromkeys(texts)]
    gated = by_id(license_scan.scan(table(spark, texts).repartition(8)))
    monkeypatch.setattr(license_scan, "PREFILTER", "")
    monkeypatch.setattr(license_scan, "RULES", [(("",), ("",), *r[2:]) for r in RULES])
    ungated = by_id(license_scan.scan(table(spark, texts).repartition(8)))
    assert gated == ungated
    for i, label in enumerate(named.values()):
        assert (label in gated[i].labels.split(",")) if label else gated[i].labels == ""


def test_running_sums(spark):
    from itertools import accumulate

    from pyspark.sql import functions as F

    from tidemark.llm.license_scan import running

    lists = [[(i * 7) % 13 for i in range(n)] for n in (0, 1, 127, 128, 129, 1000)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<bigint>").select("i", running(F.col("x")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: list(accumulate(x)) for i, x in enumerate(lists)}


def test_a_text_of_many_matches(spark):
    import time

    from tidemark.llm import license_scan

    def scan(n):
        began = time.time()
        text = "mit license " * n + "gnu lesser general public license"
        r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (2 * n + 5, n + 1, 0, 2 * n + 2, "gpl,lgpl,mit")
        return time.time() - began

    scan(10)
    assert scan(200_000) < scan(2_000) + 15  # time in proportion; by an array that grows it would be hours
