"""Identity cascades in the order of the rows: a row also matches what earlier rows created.

Row by row is one task. Here all rows are decided at once against the creations and aliases that the last round found, each row seeing only those of
earlier rows, until no decision changes. A decision depends on earlier rows alone, so round k settles every row whose chain of such rows is
shorter than k, whatever the first guess was, and what is left unchanged is the result of going row by row.

Most rows have to do with few others, so they take a shorter way first: rows that share a name, a handler or a containment are one group, and small groups are walked through
row by row beside each other (``_in_groups``). Rounds are left for large groups, and for names that only Spark's own patterns compare.

What a row matched is a pair: ``made`` false and the id of a stored record, or ``made`` true and the ``_seq`` of the row that created it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderspark.functions import names as N
from ladderspark.operators import identity as I
from ladderspark.operators.scan import first_rows, row_numbers, spread
from ladderspark.storage import materialize

BEFORE = -(1 << 62)  # time of stored records
SMALL = 500  # rows and stored records of a group that one task walks through
_ROUNDS = 8  # of passing labels on; groups that still grow then are not walked through
_PART = 100_000  # rows of groups in a part


def _settled(state: DataFrame, name: str) -> tuple[DataFrame, bool]:
    state = materialize(state, name)
    return state.drop("moved"), state.filter("moved").isEmpty()


def _with_ids(state: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state with ``id``, ids of the creators): new ids follow the highest stored one in ``_seq`` order."""
    top = dim.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    made = row_numbers(state.filter("stage = 'new'").select("_seq"), [], [F.col("_seq")], "_n")
    made = materialize(made.select(F.col("_seq").alias("ref"), F.lit(True).alias("made"), (F.col("_n") + top).alias("_new")), "created")
    return state.join(spread(made), ["made", "ref"], "left").withColumn("id", F.coalesce("_new", "ref")).drop("_new"), made


def _first_by_name(events: DataFrame) -> DataFrame:
    """(name, time, made, ref, source) -> the earliest of each name: later ones find it taken."""
    return events.groupBy("name").agg(F.min(F.struct("time", "made", "ref", "source")).alias("e")).select("name", "e.*")


def _created_aliases(events: DataFrame, made: DataFrame) -> DataFrame:
    new = events.filter(F.col("time") > BEFORE).join(spread(made), ["made", "ref"], "left")
    return new.select(F.col("name").alias("alias_name"), F.coalesce("_new", "ref").alias("canonical_id"), "source", F.col("time").alias("_seq"))


# ---------------------------------------------------------------- small groups


def _groups(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(handler_id, label) and the labels to leave out. ``named`` has ``handler_id, name``: handlers (or rows, by ``_seq``) with a name in common get one label.

    Every handler begins with its own label, and names pass the lowest one on. A name whose handlers still differ at the end tells which labels are not done.
    """
    both = named.filter("name <> ''").groupBy("name").agg(F.min("handler_id").alias("lo"), F.max("handler_id").alias("hi")).filter("lo < hi")
    shared = materialize(named.join(spread(both.select("name")), "name", "left_semi"), "shared-names")
    labels = materialize(named.select("handler_id", F.col("handler_id").alias("label")).distinct(), "labels")
    for left in reversed(range(_ROUNDS)):
        seen = shared.join(spread(labels), "handler_id")
        differ = materialize(seen.groupBy("name").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("name", "lo"), "differ")
        passed = seen.join(spread(differ), "name")
        if not left or differ.isEmpty():
            return labels, passed.select("label").distinct()
        labels = labels.union(passed.select("handler_id", "lo")).groupBy("handler_id").agg(F.min("label").alias("label"))
        labels = materialize(labels, "labels")


_STORED_ALIAS, _STORED_NAME, _STORED_TEAM, _MET, _ROW = range(5)


def _decided(out: list[tuple[int, str, bool, int]]) -> pa.RecordBatch:
    types = [("_seq", pa.int64()), ("stage", pa.string()), ("made", pa.bool_()), ("ref", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])


def _walks(walk: Callable[[list[dict]], Iterator[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by group, kind and ``_seq``; one group is held at a time."""
    def walks(batches):
        out = []
        for _, group in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["label"]):
            out.extend(walk(list(group)))
            if len(out) >= 10_000:
                yield _decided(out)
                out = []
        yield _decided(out)

    return walks


def _in_groups(fed: DataFrame, left_out: DataFrame, odd: Column, walk: Callable) -> DataFrame:
    """``_seq, stage, made, ref`` of the rows (kind ``_ROW``) in small groups: walked through one after the other, groups beside each other.

    ``fed`` has ``label, kind, _seq`` and what ``walk`` reads. Groups with too many records, of a label in ``left_out`` or with an ``odd`` record are not walked through.
    """
    fed = materialize(fed, "groups")
    other = fed.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.bool_or(odd).alias("odd")).filter(f"n > {SMALL} or odd").select("label")
    parts = max(int(fed.sparkSession.conf.get("spark.sql.shuffle.partitions")), fed.count() // _PART)
    fed = fed.join(spread(other.union(left_out)), "label", "left_anti").repartition(parts, "label").sortWithinPartitions("label", "kind", "_seq")
    return materialize(fed.mapInArrow(_walks(walk), "_seq bigint, stage string, made boolean, ref bigint"), "walked")


# ---------------------------------------------------------------- handlers


def _decide_handlers(rows: DataFrame, creators: DataFrame, events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stage and match of every row, given the creators and the first alias of each name."""
    a = events.select(F.col("name").alias("norm"), F.struct("made", "ref").alias("_alias"), F.col("time").alias("_at"))
    d = rows.join(spread(a), "norm", "left").withColumn("_alias", F.when(F.col("_at") < F.col("_seq"), F.col("_alias")))
    own = creators.select("norm", "country", F.col("_seq").alias("_own"))
    d = d.join(spread(own), ["norm", "country"], "left")
    made = lambda s: F.struct(F.lit(True).alias("made"), s.alias("ref"))
    kept = lambda i: F.struct(F.lit(False).alias("made"), i.alias("ref"))
    exact = F.coalesce(F.when(F.col("exact_id").isNotNull(), kept(F.col("exact_id"))), F.when(F.col("_own") < F.col("_seq"), made(F.col("_own"))))
    # Creators of the name in any country, among the rows of the name in their order.
    earlier = Window.partitionBy("norm").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    is_creator = F.col("_own") == F.col("_seq")
    d = d.withColumns({"_k": F.count_if(is_creator).over(earlier), "_first": F.min(F.when(is_creator, F.col("_seq"))).over(earlier)})
    stored_n = F.coalesce("stored_n", F.lit(0))
    single = F.when(stored_n + F.col("_k") == 1, F.when(stored_n == 1, kept(F.col("stored_id"))).otherwise(made(F.col("_first"))))
    by_name = F.when(F.contains("norm", F.lit(" ")), single)
    live = pairs.filter("not stored").join(spread(creators.select(F.col("_seq").alias("other"))), "other", "left_semi").select("norm", "country", F.lit(True).alias("made"), F.col("other").alias("ref"), F.col("other").alias("time"))
    live = live.union(pairs.filter("stored").select("norm", "country", F.lit(False), "other", F.lit(BEFORE)))
    # Of all that contain or are contained only the two earliest can matter: later ones only make it more than one.
    place = F.row_number().over(Window.partitionBy("norm", "country").orderBy("time", "ref"))
    two = live.withColumn("_p", place).filter("_p <= 2").groupBy("norm", "country").agg(
        F.min(F.when(F.col("_p") == 1, F.struct("time", "made", "ref"))).alias("_c1"), F.min(F.when(F.col("_p") == 2, F.col("time"))).alias("_c2"))
    d = d.join(spread(two), ["norm", "country"], "left")
    one = (F.col("_c1.time") < F.col("_seq")) & ~F.coalesce(F.col("_c2") < F.col("_seq"), F.lit(False))
    inside = F.when(one, F.struct(F.col("_c1.made").alias("made"), F.col("_c1.ref").alias("ref")))
    d = d.withColumns({"_exact": exact, "_name": by_name, "_inside": inside})
    stage = (F.when(F.col("_alias").isNotNull(), "alias").when(F.col("_exact").isNotNull(), "exact").when(F.col("_name").isNotNull(), "name")
             .when(F.col("_inside").isNotNull(), "containment").otherwise("new"))
    return d.withColumn("stage", stage).withColumn("_m", F.coalesce("_alias", "_exact", "_name", "_inside", made(F.col("_seq")))).select(
        *rows.columns, "stage", "_m.made", "_m.ref")


def _walk_handlers(group: list[dict]) -> Iterator[tuple[int, str, bool, int]]:
    """(_seq, stage, made, ref) of the names of one group, one after the other. What meets by containment comes first, names by ``_seq``."""
    alias, creators, born, meets = {}, {}, set(), {}
    for r in group:
        seq, norm = r["_seq"], r["norm"]
        if r["kind"] == _MET:
            meets.setdefault(seq, []).append((not r["stored"], r["ref"]))
            continue
        same, made = creators.setdefault(norm, []), r["alias_id"] is None and alias.get(norm)
        known, inside = (r["stored_n"] or 0) + len(same), [m for m in meets.get(seq, ()) if not m[0] or m in born]
        if r["alias_id"] is not None or made:
            stage, it = "alias", made or (False, r["alias_id"])
        elif r["exact_id"] is not None:
            stage, it = "exact", (False, r["exact_id"])
        elif " " in norm and known == 1:
            stage, it = "name", same[0] if same else (False, r["stored_id"])
        elif len(inside) == 1:
            stage, it = "containment", inside[0]
            alias.setdefault(norm, it)
        else:
            stage, it = "new", (True, seq)
            same.append(it)
            born.add(it)
            for turned in r["turned"]:
                alias.setdefault(turned, it)
        yield seq, stage, *it


def _walked_handlers(units: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """``_seq, stage, made, ref`` of the names in small groups.

    A name has to do with names of the same words (it or a turned form of it is the other) and with those that it contains or that contain it.
    """
    words = F.array_join(F.array_sort(F.split("norm", " ")), " ")
    meets = pairs.filter("not stored").select("_seq", "other")
    named = units.select("_seq", F.concat(F.lit("w "), words).alias("name")).union(meets.select("_seq", F.concat(F.lit("m "), F.col("other").cast("string")))).union(
        meets.select("other", F.concat(F.lit("m "), F.col("other").cast("string"))).distinct())
    labels, open_ = _groups(materialize(named.withColumnRenamed("_seq", "handler_id"), "named"))
    labels = labels.withColumnRenamed("handler_id", "_seq")
    aliases = _first_by_name(known).select(F.col("name").alias("norm"), F.col("ref").alias("alias_id"))
    none = lambda t: F.lit(None).cast(t)
    rows = units.join(spread(aliases), "norm", "left").join(spread(labels), "_seq").select(
        "label", F.lit(_ROW).alias("kind"), "_seq", "norm", none("boolean").alias("stored"), none("bigint").alias("ref"), "stored_n", "stored_id", "exact_id", "alias_id", N.name_rotations(F.col("norm")).alias("turned"))
    met = pairs.join(spread(labels), "_seq").select(
        "label", F.lit(_MET), "_seq", none("string"), "stored", F.col("other"), none("bigint"), none("bigint"), none("bigint"), none("bigint"), none("array<string>"))
    return _in_groups(rows.union(met), open_, F.lit(False), _walk_handlers)


def resolve_handlers(names: DataFrame, dim: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Handlers as they come (J7): (rows, created handlers, created aliases).

    ``names`` has ``raw, country, _seq``; ``dim`` has ``id, norm, country``; ``alias`` has ``alias_name, canonical_id``. Rows: ``raw, country, norm, _seq, stage,
    handler_id``, one per (raw, country). A new handler writes the rotations of its name as aliases, a match by containment writes the name itself; an alias that is
    taken stays. Null names count as empty.
    """
    d = first_rows(names.select(F.coalesce("raw", F.lit("")).alias("raw"), F.coalesce("country", F.lit("")).alias("country"), "_seq"), ["raw", "country"], F.col("_seq"))
    d = d.withColumn("norm", N.normalize_name(F.col("raw")))
    stored = dim.filter("norm is not null").groupBy("norm").agg(F.count(F.lit(1)).alias("stored_n"), F.min("id").alias("stored_id"))
    exact = dim.groupBy("norm", "country").agg(F.min("id").alias("exact_id"))
    rows = materialize(d.join(spread(stored), "norm", "left").join(spread(exact), ["norm", "country"], "left"), "asked")
    units = materialize(first_rows(rows.drop("raw"), ["norm", "country"], F.col("_seq")), "units")
    # All names that may meet by containment: stored ones have even keys, the first rows of a name odd ones.
    asked = units.select((F.col("_seq") * 2 + 1).alias("key"), "norm", "country")
    stored_names = dim.select((F.col("id") * 2).alias("id"), "norm", "country")
    pairs = I.containment_pairs(asked, stored_names, own=True).join(spread(asked), "key").select(
        "norm", "country", F.shiftright("key", 1).alias("_seq"), (F.col("id") % 2 == 0).alias("stored"), F.shiftright("id", 1).alias("other"))
    pairs = materialize(pairs, "containment-pairs")
    known = alias.select(F.col("alias_name").alias("name"), F.lit(BEFORE).alias("time"), F.lit(False).alias("made"), F.col("canonical_id").alias("ref"), F.lit("").alias("source"))

    def events_of(state):
        creators = state.filter("stage = 'new'")
        turned = creators.select(F.explode(N.name_rotations(F.col("norm"))).alias("name"), F.col("_seq").alias("time"), F.lit(True), F.col("_seq").alias("ref"), F.lit("Import"))
        fuzzy = state.filter("stage = 'containment'").select(F.col("norm").alias("name"), F.col("_seq").alias("time"), "made", "ref", F.lit("FuzzyMatch"))
        return _first_by_name(known.union(turned).union(fuzzy))

    walked = _walked_handlers(units, known, pairs)
    settled = units.join(spread(walked), "_seq").select(*units.columns, "stage", "made", "ref")
    rest = materialize(units.join(spread(walked), "_seq", "left_anti").select(units.columns), "rest")
    state, still = rest.select("*", F.lit("new").alias("stage"), F.lit(True).alias("made"), F.col("_seq").alias("ref")), rest.isEmpty()
    while not still:
        old = state.select("_seq", F.struct("stage", "made", "ref").alias("_old"))
        creators = state.filter("stage = 'new'").select("norm", "country", "_seq")
        new = _decide_handlers(rest, creators, events_of(state), pairs).join(spread(old), "_seq")
        state, still = _settled(new.withColumn("moved", F.col("_old") != F.struct("stage", "made", "ref")).drop("_old"), "cascade")
    state = materialize(settled.unionByName(state), "cascade")
    events = materialize(events_of(state), "aliases")
    creators = state.filter("stage = 'new'").select("norm", "country", "_seq")
    done = materialize(_decide_handlers(rows, creators, events, pairs), "decided")
    done, made = _with_ids(done, dim)
    done = materialize(done.select("raw", "country", "norm", "_seq", "stage", F.col("id").alias("handler_id")), "resolved")
    return done, I.new_handlers(done), _created_aliases(events, made)


# ---------------------------------------------------------------- entities of a handler


def _own(d: DataFrame, owned: DataFrame) -> DataFrame:
    """The rows of d (handler_id, _seq, made, ref) whose match the handler has had before."""
    o = owned.select("handler_id", "made", "ref", F.col("time").alias("_since"))
    return d.join(spread(o), ["handler_id", "made", "ref"]).filter(F.col("_since") < F.col("_seq")).drop("_since")


def _decide_entities(rows: DataFrame, tries: DataFrame, state: DataFrame, known: DataFrame, stored: DataFrame, teams: DataFrame) -> DataFrame:
    """Rows with stage and match, given the last round's state (see ``resolve_entities``)."""
    dogs = _dogs(state, stored)
    owned = teams.union(state.select("handler_id", "made", "ref", F.col("_seq"))).groupBy("handler_id", "made", "ref").agg(F.min("time").alias("time"))
    events = _entity_aliases(state, known, stored)
    order = F.struct("no", "made", "ref")
    first = lambda hits, name: hits.groupBy("_seq").agg(F.min(order).alias(name))
    by_alias = tries.join(spread(events.select("name", "time", "made", "ref")), "name").filter(F.col("time") < F.col("_seq"))
    names = dogs.select("made", "ref", "time", "size", F.explode(F.array_distinct(F.array("call_norm", "reg_norm"))).alias("name")).filter("name <> ''")
    # Elsewhere only the first record of a name and size can be hit, so a name that everybody uses stays one row.
    world = names.groupBy("name", "size").agg(F.min(F.struct("made", "ref", "time")).alias("w")).select("name", "size", "w.made", "w.ref", "w.time")
    by_name = tries.join(spread(world), ["name", "size"]).filter(F.col("time") < F.col("_seq"))
    mine = owned.select("handler_id", "made", "ref", F.col("time").alias("since")).join(spread(names.withColumnRenamed("size", "own_size").withColumnRenamed("name", "own_name")), ["made", "ref"])
    mine = materialize(mine.select("handler_id", "made", "ref", "since", "own_size", "own_name"), "own-names")
    own_exact = tries.join(spread(mine.withColumnRenamed("own_name", "name")), ["handler_id", "name"]).filter((F.col("since") < F.col("_seq")) & (F.col("size") == F.col("own_size")))
    near = I.near_names(tries.filter(F.length("name") >= 3), mine).filter(F.col("since") < F.col("_seq"))
    near = near.groupBy("_seq").agg(F.min(F.struct("made", "ref")).alias("_lo"), F.max(F.struct("made", "ref")).alias("_hi")).filter("_lo = _hi")
    d = rows.join(spread(first(_own(by_alias, owned), "_a")), "_seq", "left").join(spread(first(own_exact, "_e")), "_seq", "left").join(spread(near.select("_seq", F.col("_lo").alias("_f"))), "_seq", "left")
    d = d.join(spread(first(by_alias, "_ga")), "_seq", "left").join(spread(first(by_name, "_gn")), "_seq", "left")
    specific = (F.length("full") > 10) | (F.length(F.coalesce("reg", F.lit(""))) > 10)
    found = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.col(f"{s}.made").alias("made"), F.col(f"{s}.ref").alias("ref")))
    there = F.when(specific, F.coalesce(found("_ga"), found("_gn")))
    stage = (F.when(F.col("_a").isNotNull(), "own alias").when(F.col("_e").isNotNull(), "own exact").when(F.col("_f").isNotNull(), "own fuzzy")
             .when(there.isNotNull(), "global").otherwise("new"))
    own = F.struct(F.lit(True).alias("made"), F.col("_seq").alias("ref"))
    d = d.withColumn("stage", stage).withColumn("_m", F.coalesce(found("_a"), found("_e"), F.col("_f"), there, own))
    return d.select(*rows.columns, "stage", "_m.made", "_m.ref")


def _dogs(state: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.union(state.filter("stage = 'new'").select(F.lit(True), F.col("_seq"), F.col("_seq"), "size", "new_call", "new_reg"))


def _entity_aliases(state: DataFrame, known: DataFrame, stored: DataFrame) -> DataFrame:
    """The first alias of each name, given the rows' stages and matches."""
    canon = _dogs(state, stored).select("made", "ref", "call_norm")
    written = state.filter("stage <> 'own alias'").join(spread(canon), ["made", "ref"], "left").select(
        F.explode(F.array_distinct(F.array_compact(F.array("full", "call", "reg")))).alias("name"), F.col("_seq").alias("time"), "made", "ref", F.lit("Import").alias("source"), "call_norm")
    written = written.filter((F.trim("name") != "") & (F.col("name") != F.coalesce("call_norm", F.lit("")))).drop("call_norm")
    return _first_by_name(known.union(written))


_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def _stands_in(short: str, long: str) -> bool:
    """Whole words of plain letters (``names.word_contained``, for lower case)."""
    at = long.find(short)
    while at >= 0:
        end = at + len(short)
        if (at == 0 or long[at - 1] not in _WORD) and (end == len(long) or long[end] not in _WORD):
            return True
        at = long.find(short, at + 1)
    return False


def _near(name: str, own: str) -> bool:
    """As ``identity.near_names`` compares: a name without any word is near to nobody."""
    short, long = (name, own) if len(name) <= len(own) else (own, name)
    return len(name) >= 3 and not _WORD.isdisjoint(short) and (name == own or len(short) >= 3 and len(short) < len(long) and _stands_in(short, long))


def _fits(a: str | None, b: str | None) -> bool:
    return a is not None and (a == b or {a, b} in ({"S", "M"}, {"I", "L"}))


def _walk_entities(group: list[dict]) -> Iterator[tuple[int, str, bool, int]]:
    """(_seq, stage, made, ref) of the rows of one group, one after the other. Stored records come first, rows by ``_seq``."""
    alias, world, owned, dogs = {}, {}, {}, {}
    for r in group:
        kind, handler, size, full, call, reg = r["kind"], r["handler_id"], r["size"], r["full"], r["call"], r["reg"]
        if kind != _ROW:
            it = (False, r["ref"])
            dogs.setdefault(it, (size, call or "", reg or ""))
            if kind == _STORED_ALIAS:
                alias[full] = it
            elif kind == _STORED_NAME:
                world[full, size] = it
            else:
                owned.setdefault(handler, {})[it] = None
            continue
        seq, mine, tries = r["_seq"], owned.setdefault(handler, {}), [n for n in (call, full, reg) if n is not None]
        called = [alias[n] for n in tries if n in alias]
        stage, it = "own alias", next((a for a in called if a in mine), None)
        if it is None:
            stage, it = "own exact", next((min(hits) for n in tries if n and size is not None and (hits := [m for m in mine if dogs[m][0] == size and n in dogs[m][1:]])), None)
        if it is None:
            near = [m for m in mine if _fits(size, dogs[m][0]) and any(_near(n, own) for own in dogs[m][1:] if own for n in tries)]
            stage, it = "own fuzzy", near[0] if len(near) == 1 else None
        if it is None and (len(full or "") > 10 or len(reg or "") > 10):
            stage, it = "global", next(iter(called), None) or next((world[n, size] for n in tries if (n, size) in world), None)
        if it is None:
            stage, it = "new", (True, seq)
            dogs[it] = (size, r["new_call"] or "", r["new_reg"] or "")
            if size is not None:
                for n in dogs[it][1:]:
                    if n:
                        world.setdefault((n, size), it)
        if stage != "own alias":
            for n in tries:
                if n.strip(" ") and n != dogs[it][1]:
                    alias.setdefault(n, it)
        mine.setdefault(it)
        yield seq, stage, *it


def _walked_entities(d: DataFrame, tries: DataFrame, known: DataFrame, stored: DataFrame, teams: DataFrame) -> DataFrame:
    """``_seq, stage, made, ref`` of the rows in small groups.

    Rows of different groups have neither a handler nor a name in common, so none sees what the other does. Stored records go to the groups that have their name or handler.
    """
    named = materialize(tries.filter("handler_id is not null and name is not null").select("handler_id", "name").distinct(), "handler-names")
    labels, open_ = _groups(named)
    by_name = materialize(named.join(spread(labels), "handler_id").select("name", "label").distinct(), "group-names")
    dogs = stored.select("ref", "size", F.col("call_norm").alias("call"), F.col("reg_norm").alias("reg"))
    none = lambda t: F.lit(None).cast(t)
    of_alias = _first_by_name(known).select("name", "ref").join(spread(by_name), "name").join(spread(dogs), "ref", "left").select(
        "label", F.lit(_STORED_ALIAS).alias("kind"), none("bigint").alias("handler_id"), none("bigint").alias("_seq"), "ref", "size", F.col("name").alias("full"), "call", "reg")
    names = dogs.select("size", F.struct("ref", "call", "reg").alias("dog"), F.explode(F.array_distinct(F.array("call", "reg"))).alias("name")).filter("name <> '' and size is not null")
    of_name = names.groupBy("name", "size").agg(F.min("dog").alias("dog")).join(spread(by_name), "name").select(
        "label", F.lit(_STORED_NAME), none("bigint"), none("bigint"), "dog.ref", "size", "name", "dog.call", "dog.reg")
    of_team = teams.select("handler_id", "ref").join(spread(labels), "handler_id").join(spread(dogs), "ref", "left").select(
        "label", F.lit(_STORED_TEAM), "handler_id", none("bigint"), "ref", "size", none("string"), "call", "reg")
    records = of_alias.union(of_name).union(of_team).select("*", none("string").alias("new_call"), none("string").alias("new_reg"))
    rows = d.join(spread(labels), "handler_id").select("label", F.lit(_ROW), "handler_id", "_seq", none("bigint"), "size", "full", "call", "reg", "new_call", "new_reg")
    texts = F.concat_ws("", "full", "call", "reg", "new_call", "new_reg")
    return _in_groups(records.union(rows), open_, F.rlike(texts, F.lit(r"[^\x00-\x7F]|[A-Z\\]")), _walk_entities)


def resolve_entities(rows: DataFrame, dim: DataFrame, owned: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities as they come (J8): (rows, created entities, created aliases).

    ``rows`` has ``handler_id, raw, size, _seq``; ``dim`` ``id, call_norm, reg_norm, size``; ``owned`` ``handler_id, id``; ``alias`` ``alias_name, canonical_id`` of call
    names. Rows: ``handler_id, raw, size, _seq, clean, full, call, reg, stage, id``, one per (handler_id, raw, size). What a row matched belongs to its handler from then on; every match but
    one by the handler's own alias writes the row's name variants as aliases. Names that backfills change later are not looked at again.
    """
    d = materialize(I.entity_names(rows), "entities")
    words = F.size(F.split("clean", " "))
    long = F.col("call").isNull() & (words >= 3)
    d = d.withColumns({
        "new_call": F.when(long, F.lit("")).otherwise(F.coalesce("call", "full")),
        "new_reg": F.when(long, F.col("full")).otherwise(F.coalesce("reg", F.when(F.col("call").isNotNull(), F.col("full")), F.lit("")))})
    tries = materialize(I.name_tries(d), "tries")
    none = F.coalesce(F.col("reg_norm"), F.lit(""))
    stored = dim.select(F.lit(False).alias("made"), F.col("id").alias("ref"), F.lit(BEFORE).alias("time"), "size", F.coalesce("call_norm", F.lit("")).alias("call_norm"), none.alias("reg_norm"))
    teams = owned.select("handler_id", F.lit(False).alias("made"), F.col("id").alias("ref"), F.lit(BEFORE).alias("time")).distinct()
    known = alias.select(F.col("alias_name").alias("name"), F.lit(BEFORE).alias("time"), F.lit(False).alias("made"), F.col("canonical_id").alias("ref"), F.lit("").alias("source"))
    walked = _walked_entities(d, tries, known, stored, teams)
    settled = d.join(spread(walked), "_seq").select(*d.columns, "stage", "made", "ref")
    rest = materialize(d.join(spread(walked), "_seq", "left_anti").select(d.columns), "rest")
    state, still = rest.select("*", F.lit("new").alias("stage"), F.lit(True).alias("made"), F.col("_seq").alias("ref")), rest.isEmpty()
    if not still:
        tries = materialize(tries.join(spread(rest.select("_seq")), "_seq", "left_semi"), "tries")
    while not still:
        old = state.select("_seq", F.struct("stage", "made", "ref").alias("_old"))
        new = _decide_entities(rest, tries, state, known, stored, teams)
        state, still = _settled(new.join(spread(old), "_seq").withColumn("moved", F.col("_old") != F.struct("stage", "made", "ref")).drop("_old"), "cascade")
    state = materialize(settled.unionByName(state), "cascade")
    events = _entity_aliases(state, known, stored)
    done, made = _with_ids(state, dim)
    done = materialize(done.select("handler_id", "raw", "size", "_seq", "clean", "full", "call", "reg", "new_call", "new_reg", "stage", "id"), "resolved")
    new = done.filter("stage = 'new'").select("id", "handler_id", F.col("new_call").alias("call_norm"), F.col("new_reg").alias("reg_norm"), "size")
    return done.drop("new_call", "new_reg"), new, _created_aliases(events, made)
