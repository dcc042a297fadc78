"""Reminders and contacts: pairing, lists, changes, spoken forms, name matching."""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from notemill.functions import fixed
from notemill.functions.text import any_of
from notemill.operators.graphs import cut_lineage
from notemill.operators.names import match_names

DEADLINE_BONUS, NO_SPAN, GATE = 40.0, 10_000.0, 0.60


class Line:
    """Open tasks and dates by their places on a line, as numbers; empty places drop out of a linked list.

    The closest pair of a task and a date lies at one place or at neighbouring ones, since anything between the two would make
    a closer pair with one of them.
    """

    def __init__(self, points: tuple[dict[int, float], dict[int, float]], bonus: float, gone: tuple[set, set]):
        self.at, self.bonus, self.gone = sorted({*points[0].values(), *points[1].values()}), bonus, gone
        number = {x: i for i, x in enumerate(self.at)}
        self.place = tuple({i: number[x] for i, x in of.items()} for of in points)
        self.open: list[tuple[list, list]] = [([], []) for _ in self.at]
        for side in (0, 1):
            for i, place in sorted(self.place[side].items()):
                self.open[place][side].append(i)  # in order, so a heap
        self.before, self.after = [*range(-1, len(self.at) - 1)], [*range(1, len(self.at)), -1]

    def between(self, one: int, two: int):
        """(distance, task, date) of the first open ones at two places."""
        if one >= 0 and two >= 0:
            apart = abs(self.at[one] - self.at[two]) - self.bonus
            for x, y in {(one, two), (two, one)}:
                if self.open[x][0] and self.open[y][1]:
                    yield apart, self.open[x][0][0], self.open[y][1][0]

    def around(self, place: int):
        for other in (self.before[place], place, self.after[place]):
            yield from self.between(place, other)

    def drop(self, side: int, i: int):
        """Takes out a point that is gone; the pairs that become neighbours."""
        place = self.place[side].get(i)
        if place is None:
            return
        for points, done in zip(self.open[place], self.gone, strict=True):
            while points and points[0] in done:
                heappop(points)
        if self.open[place][0] or self.open[place][1]:
            yield from self.around(place)
            return
        before, after = self.before[place], self.after[place]
        if before >= 0 and self.after[before] == place:
            self.after[before] = after
        if after >= 0 and self.before[after] == place:
            self.before[after] = before
        yield from self.between(before, after)


def nearest_pairs(tasks: list[tuple], dates: list[tuple]) -> list[tuple[int, int]]:
    """Numbers of paired tasks and dates, pairs taken by distance, task and date until either side is used up.

    ``tasks`` are (value, middle) and ``dates`` (identity, middle, bonus); of equal values the first that is taken counts. Points
    without a middle are ``NO_SPAN`` from all others. Dates of one bonus form a line with all tasks; a heap holds the
    neighbours of all lines, so n points take n log n steps.
    """
    gone: tuple[set, set] = (set(), set())
    placed = {i: m for i, (_, m) in enumerate(tasks) if m is not None}
    lines = [Line((placed, {i: m for i, (_, m, x) in enumerate(dates) if m is not None and x == bonus}), bonus, gone) for bonus in {x for *_, x in dates}]
    same: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
    for side, points in enumerate((tasks, dates)):
        for i, (value, *_) in enumerate(points):
            same[side][value].append(i)
    seen = {pair for line in lines for place in range(len(line.at)) for pair in line.around(place)}
    heap = sorted(seen)
    #: the first open points, those of any kind and those without a middle
    first = [[iter(range(len(points))), iter([i for i, x in enumerate(points) if x[1] is None])] for points in (tasks, dates)]
    at = [[next(x, None) for x in of] for of in first]
    out = []
    while True:
        for side in (0, 1):
            for k in (0, 1):
                while at[side][k] in gone[side]:
                    at[side][k] = next(first[side][k], None)
        loose = [(NO_SPAN, t, d) for t, d in ((at[0][0], at[1][1]), (at[0][1], at[1][0])) if t is not None and d is not None]
        while heap and (heap[0][1] in gone[0] or heap[0][2] in gone[1]):
            heappop(heap)
        if not heap and not loose:
            return out
        _, t, d = min([*heap[:1], *loose])
        out.append((t, d))
        dropped = (same[0][tasks[t][0]], same[1][dates[d][0]])
        for side in (0, 1):
            gone[side].update(dropped[side])
        for side in (0, 1):
            for i in dropped[side]:
                for line in lines:
                    for pair in line.drop(side, i):
                        if pair not in seen:
                            seen.add(pair)
                            heappush(heap, pair)


def pair_tasks(tasks: DataFrame, dates: DataFrame) -> DataFrame:
    """One date at most per task and the other way round, nearest first: ``note_id, task, date``.

    Pairs of a note are taken in the order of distance, task and date until its tasks or dates are used up.
    A task holds all of one note's tasks and dates, which its text bounds, but not their pairs.
    """
    mid = (F.col("start") + F.col("end")) / 2
    t = tasks.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct(F.col("value").alias("task"), mid.alias("tm")))).alias("t"))
    bonus = F.when(F.col("kind") == "deadline", DEADLINE_BONUS).otherwise(0.0).alias("bonus")
    d = dates.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("start", "value", mid.alias("dm"), bonus))).alias("d"))
    both = t.join(d, "note_id").select("note_id", "t.task", "t.tm", F.col("d.start").alias("date_start"), F.col("d.value").alias("date"), "d.dm", "d.bonus")
    types = {f.name: f.dataType for f in both.schema}
    schema = StructType([both.schema["note_id"], StructField("task", types["task"].elementType), StructField("date", types["date"].elementType), StructField("date_start", types["date_start"].elementType)])

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                named = list(zip(row["date_start"], row["date"], strict=True))
                for a, b in nearest_pairs(list(zip(row["task"], row["tm"], strict=True)), list(zip(named, row["dm"], row["bonus"], strict=True))):
                    out.append((row["note_id"], row["task"][a], row["date"][b], row["date_start"][b]))
            columns = zip(*out, strict=True) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = list(to_arrow_schema(schema).types)
    return both.mapInArrow(assign, schema)


def detect(tasks: DataFrame, dates: DataFrame, gate: float = GATE) -> DataFrame:
    """Tasks with their date, unpaired deadlines by themselves; ``accepted`` marks those over the gate."""
    tasks, dates = cut_lineage(tasks), cut_lineage(dates)  # read several times, and much smaller than the texts
    pairs = cut_lineage(pair_tasks(tasks, dates))
    dated = pairs.join(dates.select("note_id", F.col("value").alias("date"), F.col("start").alias("date_start"), "normalized", F.col("confidence").alias("dc")), ["note_id", "date", "date_start"])
    both = tasks.select("note_id", F.col("value").alias("task"), F.col("confidence").alias("tc")).join(dated, ["note_id", "task"], "left")
    own = both.select("note_id", F.col("task").alias("title"), F.col("normalized").alias("due_date"), F.least("tc", F.coalesce("dc", "tc")).alias("confidence"))
    alone = dates.where("kind = 'deadline'").join(pairs.select("note_id", F.col("date").alias("value"), F.col("date_start").alias("start")), ["note_id", "value", "start"], "left_anti")
    extra = alone.select("note_id", F.col("value").alias("title"), F.col("normalized").alias("due_date"), "confidence")
    return own.unionByName(extra).withColumn("accepted", F.col("confidence") >= gate)


def create(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Accepted reminders that a note doesn't have yet."""
    new = found.where("accepted").dropDuplicates(["note_id", "title", "due_date"])
    old = existing.select("note_id", "title", "due_date")
    same = (new["note_id"] == old["note_id"]) & (new["title"] == old["title"]) & new["due_date"].eqNullSafe(old["due_date"])
    return new.join(old, same, "left_anti")


def pending(reminders: DataFrame, until: int | None = None) -> DataFrame:
    out = reminders.where("status = 'pending' AND due_epoch IS NOT NULL")
    return out if until is None else out.where(F.col("due_epoch") <= until)


def due_soon(reminders: DataFrame, alerts: DataFrame, now: int, lead_minutes: int = 60) -> DataFrame:
    return pending(reminders, now + 60 * lead_minutes).join(alerts.select("reminder_id"), "reminder_id", "left_anti")


def update(reminders: DataFrame, changes: DataFrame, key: str = "reminder_id") -> DataFrame:
    """Columns of ``changes`` that aren't null replace the old ones; rows with ``removed`` go."""
    names = [c for c in reminders.columns if c != key and c in changes.columns]
    new = changes.select(F.col(key), F.coalesce("removed", F.lit(False)).alias("_gone"), *[F.col(c).alias(f"_n_{c}") for c in names])
    both = reminders.join(new, key, "left").where(~F.coalesce("_gone", F.lit(False)))
    return both.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in names else F.col(c) for c in reminders.columns])


def speak(due: Column, now: Column) -> Column:
    """Day and time of ``due`` as said at ``now``, both in epoch seconds."""
    at = F.timestamp_seconds(due)
    days = (F.floor(due / 86400) - F.floor(now / 86400)).cast("int")
    name = F.date_format(at, "EEEE")
    day = F.when(days == 0, "today").when(days == 1, "tomorrow").when(days == -1, "yesterday").when(days.between(2, 6), F.concat(F.lit("on "), name)).when(days.between(-6, -2), F.concat(F.lit("last "), name)).otherwise(F.concat(F.lit("on "), F.dayofmonth(at).cast("string"), F.lit(" "), F.date_format(at, "MMMM")))
    hour, minute = F.hour(at), F.minute(at)
    clock = F.concat(F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.when(minute > 0, F.format_string(":%02d", minute)).otherwise(""), F.when(hour < 12, " am").otherwise(" pm"))
    return F.when((hour == 0) & (minute == 0), day).otherwise(F.concat(day, F.lit(" at "), clock))


def describe_window(hours: Column) -> Column:
    days = F.floor(hours / 24)
    weeks = F.floor(days / 7)
    said = lambda n, unit: F.concat(F.lit("the next "), n.cast("string"), F.lit(unit))
    return F.when(hours <= 1, "the next hour").when(hours <= 24, said(hours, " hours")).when(hours == 48, "the next two days").when(days == 7, "the next week").when(days < 7, said(days, " days")).when(days.isin(30, 31), "the next month").when(days >= 365, "the next year").when(weeks == 1, "the next week").otherwise(said(weeks, " weeks"))


def narrate(reminders: DataFrame, by: str, now: int, hours: int) -> DataFrame:
    """One sentence per group: the three first reminders by due time, the others counted."""
    order = Window.partitionBy(by).orderBy("due_epoch", "reminder_id")
    item = F.concat("title", F.lit(", "), speak(F.col("due_epoch"), F.lit(now)))
    rows = reminders.withColumn("n", F.row_number().over(order)).groupBy(by).agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", item.alias("s"))))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["s"]), ". ")
    more = F.when(F.col("count") > 3, F.concat(F.lit(". And "), (F.col("count") - 3).cast("string"), F.lit(" more"))).otherwise("")
    lead = F.concat(F.lit("You have "), F.col("count").cast("string"), F.lit(" reminder"), F.when(F.col("count") == 1, "").otherwise("s"), F.lit(" in "), describe_window(F.lit(hours)), F.lit(". "))
    return rows.select(by, F.concat(lead, body, more, F.lit(".")).alias("spoken"))


# ---- contacts ----


def normalize_name(name: Column) -> Column:
    """Match key: no title, no punctuation but ' and -, single blanks, lower case."""
    bare = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), rf"^(?i:{any_of(fixed.TITLES)})\.?\s+", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s'-]", ""), r"\s+", " ")))


def resolve_contacts(mentions: DataFrame, cutoff: float, components) -> DataFrame:
    """``name, contact``: mentions of one person share the smallest of their names."""
    keys = mentions.select(normalize_name(F.col("name")).alias("name")).where("name <> ''").distinct()
    near = match_names(keys, keys.select(F.col("name")), cutoff, other=True)
    links = near.select(F.col("name").alias("a"), F.col("match").alias("b"))
    return keys.join(components(links), keys["name"] == F.col("v"), "left").select("name", F.coalesce("label", "name").alias("contact"))


def absorb_details(links: DataFrame, notes: DataFrame, contacts: DataFrame, email: str = "email", phone: str = "phone") -> DataFrame:
    """E-mail and phone of notes that name one contact only fill blanks of that contact, earliest note first."""
    single = links.groupBy("note_id").agg(F.count("*").alias("n"), F.min("contact_id").alias("contact_id")).where("n = 1").drop("n")
    found = single.join(notes, "note_id").groupBy("contact_id").agg(F.min(F.when(F.col(email).isNotNull(), F.struct("created_epoch", "note_id", email))).alias("e"), F.min(F.when(F.col(phone).isNotNull(), F.struct("created_epoch", "note_id", phone))).alias("p"))
    rest = [c for c in contacts.columns if c not in (email, phone)]
    return contacts.join(found, "contact_id", "left").select(*rest, F.coalesce(F.nullif(F.trim(contacts[email]), F.lit("")), F.col(f"e.{email}")).alias(email), F.coalesce(F.nullif(F.trim(contacts[phone]), F.lit("")), F.col(f"p.{phone}")).alias(phone))


def suggest_actions(contacts: DataFrame) -> DataFrame:
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    actions = F.array_compact(F.array(F.when(has("phone"), "call"), F.when(has("phone"), "message"), F.when(has("email"), "email")))
    return contacts.select("contact_id", F.explode(actions).alias("action"))
