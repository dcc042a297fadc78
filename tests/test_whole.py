"""Cases that cuts would lose: many tasks in a note, long notes, names with other first letters."""

import random
from difflib import SequenceMatcher

import duckdb

import __spark_entry__
from notemill.operators import graphs, models, reminders, tokens


def greedy(tasks, dates):
    """The reference's assignment: all pairs by distance, then by task and date."""
    mid = lambda x: (x[1] + x[2]) / 2
    pairs = sorted((abs(mid(d) - mid(t)) - (reminders.DEADLINE_BONUS if d[3] == "deadline" else 0), t[0], d[1], d[0]) for t in tasks for d in dates)
    out, taken = {}, set()
    for _, task, start, date in pairs:
        if task not in out and (start, date) not in taken:
            out[task] = (date, start)
            taken.add((start, date))
    return out


def test_all_tasks_get_a_date(spark):
    first = {1: ([(f"task {i:02d}", 20 * i, 20 * i + 9, "task") for i in range(50)], [(f"day {i}", 2000 + 20 * i, 2006 + 20 * i, "deadline" if i % 3 == 0 else "date") for i in range(50)])}
    first[2] = ([(f"task {i}", 37 * i % 400, 37 * i % 400 + 8, "task") for i in range(30)], [(f"day {i}", 53 * i % 400, 53 * i % 400 + 6, "deadline" if i % 2 else "date") for i in range(41)])
    table = lambda k: spark.createDataFrame([(n, *x) for n, both in first.items() for x in both[k]], "note_id long, value string, start int, end int, kind string")
    got = {n: {} for n in first}
    for r in reminders.pair_tasks(table(0), table(1)).collect():
        assert r.task not in got[r.note_id]
        got[r.note_id][r.task] = (r.date, r.date_start)
    assert got == {n: greedy(*both) for n, both in first.items()}
    assert len(got[1]) == 50 and len(got[2]) == 30


def plain_themes(scored, most_themes, most_topics):
    """The reference's fold, theme by theme."""
    themes = []
    for term, score in sorted(scored.items(), key=lambda x: (-x[1], x[0])):
        words = set(term.split())
        home = next((t for t in themes if t[3] & words), None)
        if home is None and len(themes) < most_themes:
            home = [term, 0.0, [], set()]
            themes.append(home)
        if home:
            home[1] += score
            home[2].append(term)
            home[3] |= words
    total, left, out = sum(t[1] for t in themes), most_topics, {}
    for name, weight, topics, _ in sorted(themes, key=lambda t: -round(t[1] / total, 4)):
        share = max(1, round(left * round(weight / total, 4))) if left > 0 else 1
        topics = topics[: max(1, min(share, left or 1))]
        left = max(0, left - len(topics))
        out[name.title()] = (round(weight / total, 4), topics)
    return out


def test_themes_of_short_and_long_notes(spark):
    short = "kernel swaps pages while kernel threads wait and pages fault " * 5
    long = " ".join(f"word{i * i % 211} thing{i % 97} matter{i % 13}" for i in range(1500))
    notes = spark.createDataFrame([(1, short), (2, long), (3, "")], "note_id long, raw_transcript string")
    scored = {}
    for r in tokens.candidate_terms(tokens.tokens(notes)).collect():
        scored.setdefault(r.note_id, {})[r.term] = r.score
    got, grouped = {}, {}
    for out, table in ((got, tokens.extract_themes(notes)), (grouped, tokens.group_themes(tokens.candidate_terms(tokens.tokens(notes)), sizes=tokens.text_sizes(notes)))):
        for r in table.collect():
            out.setdefault(r.note_id, {})[r.theme] = (round(r.weight, 9), r.topics)
    assert got == grouped == {1: plain_themes(scored[1], 1, 1), 2: plain_themes(scored[2], 9, 125)}
    assert len(scored[2]) > 60 and sum(len(t) for _, t in got[2].values()) > 60


def test_names_with_other_ends_match(spark):
    rng = random.Random(7)
    pool = ["catherine smith", "elena fischerz", "li", "bo", "x", "marco rossi", "anna maria lopez garcia"]
    heard = ["katherine smithe", "olena fischer", "li", "ob"]
    for _ in range(150):
        word = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 16)))
        pool.append(word)
        other = list(word)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(other) + 1)
            other[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        heard.append("".join(other) or "q")
    pool, heard = sorted(set(pool)), sorted(set(heard))
    for other in (False, True):
        want = {}
        for name in heard:
            near = [(-SequenceMatcher(None, x, name).ratio(), x) for x in pool if not (other and x == name)]
            if min(near)[0] <= -0.82:
                want[name] = min(near)[1]
        table = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
        assert {r.name: r.match for r in reminders.match_names(table(heard), table(pool), 0.82, other).collect()} == want
    assert want["katherine smithe"] == "catherine smith" and want["olena fischer"] == "elena fischerz"


def test_library_queries_read_all_documents(spark):
    queries, sf = __spark_entry__.queries(), "/root/testdata/sf0.001"
    counts = {r.name: r.notes for r in queries["c06_notes_for_all_contacts"](spark, sf).collect()}
    assert {"Mensah", "Okafor", "Lena", "Priya"} <= set(counts)
    duck = duckdb.sql(__spark_entry__.oracle_sql()["g09_list_sources"].replace("FROM documents", f"FROM '{sf}/documents.parquet'"))
    assert sorted(map(tuple, queries["g09_list_sources"](spark, sf).collect())) == sorted(duck.fetchall())
    assert all(r.ratio >= 0.82 for r in queries["c02_match_people"](spark, sf).collect())


def test_ranks_converge(spark):
    n = 12
    links = [(0, i, j, 1.0 + i) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    total = {i: sum(w for _, a, _, w in links if a == i) for i in range(n)}
    want = [1 / n] * n
    for _ in range(300):
        want = [0.15 / n + 0.85 * sum(want[a] * w / total[a] for _, a, b, w in links if b == v) for v in range(n)]
    vertices = spark.createDataFrame([(0, i) for i in range(n)] + [(1, i) for i in range(3)], "note_id long, v int")
    got = {(r.note_id, r.v): r.rank for r in graphs.pagerank(vertices, spark.createDataFrame(links, "note_id long, a int, b int, w double"), "note_id").collect()}
    assert len(got) == n + 3 and all(abs(got[0, v] - want[v]) < 1e-5 for v in range(n)) and abs(got[1, 0] - 1 / 3) < 1e-9


def test_models_train_in_full(spark):
    notes = spark.createDataFrame([(i, " ".join(f"word{j}" for j in range(7000 * i, 7000 * i + 7000))) for i in range(3)], "note_id long, raw_transcript string")
    counter, lda = models.fit_lda(notes, 2)
    assert len(counter.vocabulary) == 21000 and lda.getMaxIter() == 50
    model = models.word2vec(notes.selectExpr("note_id", "substring(raw_transcript, 1, 200) AS raw_transcript"))
    assert model.getMaxIter() == 30 and model.getVectorSize() == 100


def test_a_note_of_one_repeated_word(spark):
    from notemill.operators import tokens as tk

    notes = spark.createDataFrame([(1, "foo foo foo foo"), (2, ""), (3, "other words stay other words")], "note_id long, raw_transcript string")
    table = tk.tokens(notes)
    assert [(r["first"], r.second, r.frequency) for r in tk.collocations(table).where("note_id = 1").collect()] == [("foo", "foo", 3)]
    got = {(r.note_id, r.term): r.score for r in tk.candidate_terms(table).collect()}
    for note, text in ((1, "foo foo foo foo"), (3, "other words stay other words")):
        assert {t: s for (n, t), s in got.items() if n == note} == tk.note_terms(text.split())
    assert {r.note_id for r in tk.extract_themes(notes).collect()} == {1, 3}


def test_entropy_and_score_of_notes(spark):
    """Q06 and Q08 to Q11: entropy over theme weights for notes with several themes, over words for others."""
    import math

    from notemill.operators import quality
    from notemill.operators import tokens as tk

    long = " ".join(f"word{i * i % 211} thing{i % 97} matter{i % 13}." for i in range(400))
    texts = ["kernel swaps pages while kernel threads wait", long, "same same same", "", "one"]
    notes = spark.createDataFrame(list(enumerate(texts)), "note_id long, raw_transcript string")

    def shares(weights):
        total = sum(weights)
        return 0.0 if len(weights) < 2 else -sum(w / total * math.log2(w / total) for w in weights if w) / math.log2(len(weights))

    want = {}
    for i, t in enumerate(texts):
        words = [w.lower().strip(".") for w in t.split()]
        kept = [r.word for r in tk.tokens(notes.where(f"note_id = {i}")).orderBy("pos").collect()]
        themes = plain_themes(tk.note_terms(kept), max(1, min(9, round(len(words) / 217))), 10**6) if kept else {}
        if kept:
            want[i] = shares([w for w, _ in themes.values()]) if len(themes) > 1 else shares(list({w: kept.count(w) for w in kept}.values()))
    assert len(plain_themes(tk.note_terms([r.word for r in tk.tokens(notes.where("note_id = 1")).orderBy("pos").collect()]), 6, 10**6)) > 1
    got = {r.note_id: r.entropy for r in tk.note_entropy(notes).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 for i in want)
    scored = {r.note_id: r for r in quality.score_notes(notes).collect()}
    assert len(scored) == 5 and all(abs(r.quality_score - (r.readability + r.cohesion + r.coherence + 1 - r.entropy) / 4) < 2e-4 for r in scored.values())
    assert all(abs(scored[i].entropy - round(want.get(i, 0.0), 4)) < 1e-3 for i in scored)


def test_cleaned_text_is_computed_once(spark):
    """The last steps name the text several times; what makes it must not stand in the plan as often."""
    from pyspark.sql import functions as F

    from notemill.functions import text

    plan = spark.range(3).select(F.col("id").cast("string").alias("t")).select(text.ensure_terminal_punctuation(F.replace("t", F.lit("needle"), F.lit(""))).alias("out"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("needle") == 1


def test_tasks_and_dates_are_found_once_for_reminders(spark):
    """Before, a plan of detect() read the texts seven times, and create() read that twice."""
    from notemill.operators import entities as en
    from notemill.operators import reminders as rm

    notes = spark.createDataFrame([(1, "I need to return the books by next Tuesday. Call Lena on May 9th.", 1704067200)], "note_id long, raw_transcript string, created_epoch long")
    found = rm.detect(en.tasks(notes), en.dates(notes))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString() and "raw_transcript" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() >= 2
