"""The corpus pipeline against a brute-force version of its stages, on a small folder of tables."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from notemill.llm import langid
from notemill.llm.registry import WORD_BPE, oracle_sql, queries, vocabulary_file


def test_names():
    assert [f"op{n}_" for n in range(1, 14)] == [re.match(r"op\d+_", n)[0] for n in queries() if n != "pipeline"]
    assert set(oracle_sql()) <= set(queries()) and len(corpus_pipeline.STAGES) == 5


def test_run(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(8)
    sounds = {"aa": ["ka", "lo", "mi", "ra"], "bb": ["stu", "ber", "ich", "ung"]}
    text = lambda lang, n: " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    items = [(0, text("aa", 20)), (1, text("bb", 30))]
    rows = [[i, text(lang, r.randint(30, 90)), lang] for i in range(80) for lang in [r.choice("ab") * 2]]
    rows[10][1] = rows[3][1]
    rows[11][1] = rows[3][1] + " more"
    rows[10][2] = rows[11][2] = rows[3][2]
    rows[20][1] += " " + items[0][1]
    rows[21][1] = items[1][1] + " " + rows[21][1]
    rows[30][1] += " write to me@example.org"
    rows += [[100, None, "aa"], [101, "12 345", "bb"], [102, "", "aa"]]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    left = {i: t for i, t, _ in rows if not langid.decide(t, model)[2]}
    grams = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in left.items()}
    for b in sorted(left):
        if any(a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) for a in left):
            del left[b]
    left = {i: t for i, t in left.items() if not any(x in t for _, x in items)}
    left = {i: t.replace("me@example.org", "<email>") for i, t in left.items()}
    library = Tokenizer.from_file(vocabulary_file(WORD_BPE))
    assert got.keys() == left.keys() and not {10, 11, 20, 21, 100, 101, 102} & got.keys() and 30 in got
    assert all(library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) == got[i].decoded for i, t in left.items())
