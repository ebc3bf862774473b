"""n-grams of every length against brute force."""

import re
from collections import Counter

from pressoir.llm import queries as llm

ASKED = ["Énergies du réseeau ?", "matériau gène éoliene", "energie, genome ou réseaux 2013", "nation été zzz", None]


def test_ngrams_of_every_length(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ASKED)), "query_id long, raw_query string").write.parquet(f"{tmp_path}/requetes.parquet")
    held = Counter()
    for t in ASKED:
        ws = re.findall(r"\w+", (t or "").lower())
        held.update((" ".join(ws[i:j]), j - i) for i in range(len(ws)) for j in range(i + 1, len(ws) + 1))
    got = {(r.gram, r.n): r.occurrences for r in llm.p6_ngrams_whole(spark, str(tmp_path)).collect()}
    assert got == held and max(n for _, n in got) == 5
