"""Identity resolution: who competed.

Resolving row by row lets a row see what earlier rows created. Here every
distinct name is matched against the stored dimension at once; what stays unmatched is grouped by
its own key and created once, with the lowest ``_seq`` as the canonical row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderspark.config import RatingConfig
from ladderspark.functions import names as N
from ladderspark.operators.scan import first_rows, row_numbers, spread
from ladderspark.operators.takers import first_takers
from ladderspark.storage import materialize

GRAM = 10  # Fixed value: shortest name that may match by containment.


def resolve_alias(df: DataFrame, alias: DataFrame, name: str = "norm") -> DataFrame:
    """Canonical id by alias name, null if there is none."""
    a = alias.select(F.col("alias_name").alias(name), F.col("canonical_id").alias("alias_id"))
    return df.join(spread(a), name, "left")


def match_exact(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Id by normalized name and country."""
    d = dim.select("norm", "country", F.col("id").alias("exact_id"))
    return df.join(spread(d), ["norm", "country"], "left")


def match_name_only(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Id by name alone, for names of two or more tokens with exactly one candidate."""
    one = dim.groupBy("norm").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("name_id")).filter("_n = 1").drop("_n")
    d = df.join(spread(one), "norm", "left")
    return d.withColumn("name_id", F.when(F.contains("norm", F.lit(" ")), F.col("name_id")))


def _parts(name: Column, country: Column, size: int) -> Column:
    """Hashes of the distinct parts of ``size`` letters, in a country."""
    parts = F.transform(F.sequence(F.lit(1), F.length(name) - size + 1), lambda i: F.substring(name, i, F.lit(size)))
    return F.transform(F.array_distinct(F.when(F.length(name) >= size, parts).otherwise(F.array().cast("array<string>"))),
                       lambda g: F.hash(country, g))


_SAMPLE = 20_000  # names whose parts are counted to know the frequent ones
_FEW = 10_000  # short names that are sent to all tasks


def _contained_pairs(short: DataFrame, long: DataFrame, size: int) -> DataFrame:
    """Pairs (s_key, s_asked, l_key, l_asked) with the short name inside the long one of its country and not equal to it.

    A contained name of at least ``size`` letters shares all its parts of that size with the longer one. Each short name is joined by one part only, the one that is rarest
    in a sample of the long names, so a beginning that everybody shares does not bring everybody together. The sample decides how many candidates there are, never which pairs are
    found. Parts go over the network as a hash and a key; the long name is looked up for candidates alone.
    """
    every = -(-long.count() // _SAMPLE) or 1
    counted = long.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select(F.explode(_parts(F.col("norm"), F.col("country"), size)).alias("part"))
    frequent = materialize(counted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "frequent")
    parts = short.select("key", "asked", "norm", "country", F.explode(_parts(F.col("norm"), F.col("country"), size)).alias("part"))
    # At most as many parts as the sample has are sent to all tasks, whatever the input is.
    parts = parts.join(F.broadcast(frequent), "part", "left")
    one = parts.groupBy("key", "asked", "norm", "country").agg(F.min_by("part", F.struct(F.coalesce("n", F.lit(0)), F.col("part"))).alias("part"))
    one = materialize(one.select("part", "country", F.col("key").alias("s_key"), F.col("asked").alias("s_asked"), F.col("norm").alias("s_norm")), "short-names")
    few = size < GRAM and one.count() <= _FEW
    met = long.select(F.col("key").alias("l_key"), F.col("asked").alias("l_asked"), F.explode(_parts(F.col("norm"), F.col("country"), size)).alias("part")).join(
        F.broadcast(one) if few else spread(one), "part")
    met = met.filter((F.col("s_key") != F.col("l_key")) | (F.col("s_asked") != F.col("l_asked"))).drop("part")
    names = long.select(F.col("key").alias("l_key"), F.col("asked").alias("l_asked"), F.col("norm").alias("l_norm"), "country")
    # Equal hashes do not make equal countries.
    found = met.join(spread(names), ["l_key", "l_asked", "country"]).filter(F.contains("l_norm", "s_norm") & (F.col("l_norm") != F.col("s_norm")))
    return found.select("s_key", "s_asked", "l_key", "l_asked")


def containment_pairs(asked: DataFrame, names: DataFrame, *, own: bool = False) -> DataFrame:
    """(key, id): the names of the country that contain an asked name or are contained in it, not equal to it.

    Only for asked names of ten letters and two tokens. ``asked`` has ``key, norm, country``, ``names`` has ``id, norm, country``. With ``own`` the asked names count as names
    too, by their keys, which are no ids then.
    """
    fits = (F.length("norm") >= GRAM) & F.contains("norm", F.lit(" "))
    names = names.filter("norm <> ''").select(F.col("id").alias("key"), F.lit(False).alias("asked"), "norm", "country")
    others = asked.filter(~fits & (F.col("norm") != "")) if own else asked.limit(0)
    names = names.union(others.select("key", F.lit(False), "norm", "country"))
    asked = asked.filter(fits).select("key", F.lit(True).alias("asked"), "norm", "country")
    # Both sides are read several times, so they are stored first.
    asked, names = materialize(asked, "asked"), materialize(names, "names")
    # Shorter names need shorter parts; those sizes are only worked through if they occur.
    size = F.when(F.length("norm") >= GRAM, GRAM).when(F.length("norm") >= 4, 4).otherwise(F.length("norm"))
    sized = names.withColumn("_size", size)
    of = lambda n: sized.filter(F.col("_size") == n).drop("_size")
    smaller = sorted(r[0] for r in sized.select("_size").distinct().collect())
    if own:
        found = [_contained_pairs(asked.union(of(GRAM)), asked.union(names), GRAM).filter("s_asked or l_asked")]
    else:
        found = [_contained_pairs(asked, names, GRAM), *[_contained_pairs(of(n), asked, n) for n in smaller if n == GRAM]]
    found += [_contained_pairs(of(n), asked, n) for n in smaller if n < GRAM]
    pair = lambda by, a, b: F.when(F.col(by), F.struct(F.col(a).alias("key"), F.col(b).alias("id")))
    both = F.explode(F.array_compact(F.array(pair("s_asked", "s_key", "l_key"), pair("l_asked", "l_key", "s_key"))))
    return reduce(DataFrame.unionByName, found).select(both.alias("p")).select("p.key", "p.id")


def match_containment(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Id of the one dimension name of the country that contains the name or is contained in it.

    Only for names of ten letters and two tokens. Needs ``key, norm, country``.
    """
    found = containment_pairs(df, dim).groupBy("key").agg(
        F.count(F.lit(1)).alias("_n"), F.min("id").alias("contained_id")
    ).filter("_n = 1").drop("_n")
    return df.join(spread(found), "key", "left")


EDITS = 2
TAIL = 7  # last letters of a dimension name; they tell more names apart than a first name does
_KEYS_PER_PART = 4_000_000


def _edit_keys(longest: int):
    """Hashes that a dimension name (``longest`` = TAIL) and a name within two edits of it (TAIL + EDITS) have in common, as a function of a name column.

    The dimension name is cut before its last TAIL letters, the other one where the edits put this cut. If the heads are equal, both tails without up to two
    letters each are equal somewhere: the key is head and shortened tail. Otherwise an edit is in the heads and the tails are within one: the key is the tail
    without up to one letter. A dimension name of fewer letters is all tail.
    """

    def keys(name: str) -> list[int]:
        n, out = len(name), set()
        for m in range(min(n, longest) + 1):
            whole = n == m
            if not whole and m < 2 * TAIL - longest:
                continue
            head, tail = crc32(name[:n - m].encode() + b"|1|"), name[n - m:]
            for i in range(max(m - TAIL, 0), min(EDITS, m) + 1):
                if not whole and m - i < TAIL - EDITS:
                    continue
                for kept in combinations(tail, m - i):
                    left = "".join(kept).encode()
                    out.add(crc32(left, head))
                    if i < EDITS and m - i >= TAIL - 1:
                        out.add(crc32(left))
        return list(out)

    @F.pandas_udf("array<bigint>")
    def of(names: pd.Series) -> pd.Series:
        return names.map(lambda name: [] if name is None else keys(name))

    return of


def edit_candidates(names: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of a ``names`` row and an ``others`` row (key, id, country) that hold all pairs within two edits; both are stored tables."""
    parts = max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), 130 * names.count() // _KEYS_PER_PART, 37 * others.count() // _KEYS_PER_PART)
    # Spread before the keys are made: small files would be one task.
    names, others = names.repartition(parts, "key"), others.repartition(parts, "id")
    a = names.select("key", "country", F.explode(_edit_keys(TAIL + EDITS)("norm")).alias("k")).repartition(parts, "country", "k")
    b = others.select("id", "country", F.explode(_edit_keys(TAIL)("other")).alias("k")).repartition(parts, "country", "k")
    return a.join(spread(b), ["country", "k"]).select("key", "id", "country").distinct()


def match_edit_distance(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Id of the one other dimension name of the country within two edits.

    Candidates come from an equality join on country and ``_edit_keys``: up to 37 rows of a dimension name and about 130 of a name, however long it is. Names that
    only share a frequent first or last name are no candidates. Each pair is compared once.
    """
    names = materialize(df.select("key", "norm", "country"), "edit-names")
    others = materialize(dim.select("id", F.col("norm").alias("other"), "country"), "edit-others")
    pairs = edit_candidates(names, others).join(spread(names), ["key", "country"]).join(spread(others), ["id", "country"])
    near = pairs.filter((F.col("norm") != F.col("other")) & (F.levenshtein("norm", "other", EDITS) >= 0))
    one = near.groupBy("key").agg(F.min("id").alias("edit_id"), F.max("id").alias("_hi")).filter("edit_id = _hi").drop("_hi")
    return df.join(spread(one), "key", "left")


# ---------------------------------------------------------------- handlers


def resolve_handlers(names: DataFrame, dim: DataFrame, alias: DataFrame) -> DataFrame:
    """Handler id and deciding stage per distinct (raw, country).

    Stages: alias, exact, name only, containment, new. New handlers get ids after the highest
    stored one, in ``_seq`` order, one per (normalized name, country).
    """
    d = first_rows(names.select("raw", "country", "_seq"), ["raw", "country"], F.col("_seq"))
    d = d.withColumn("norm", N.normalize_name(F.col("raw"))).withColumn("key", F.col("_seq"))
    d = materialize(match_name_only(match_exact(resolve_alias(d, alias), dim), dim), "handlers")
    left = match_containment(d.filter("alias_id is null and exact_id is null and name_id is null"), dim)
    got = d.filter("alias_id is not null or exact_id is not null or name_id is not null").withColumn(
        "contained_id", F.lit(None).cast("bigint"))
    d = got.unionByName(left.select(got.columns))
    stage = (
        F.when(F.col("alias_id").isNotNull(), "alias").when(F.col("exact_id").isNotNull(), "exact")
        .when(F.col("name_id").isNotNull(), "name").when(F.col("contained_id").isNotNull(), "containment").otherwise("new")
    )
    d = d.withColumn("stage", stage).withColumn("id", F.coalesce("alias_id", "exact_id", "name_id", "contained_id"))
    new = d.filter("stage = 'new'").groupBy("norm", "country").agg(F.min("_seq").alias("_first"))
    top = dim.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    new = row_numbers(new, [], [F.col("_first")], "_n").select(
        "norm", "country", (F.col("_n") + top).alias("new_id"))
    d = d.join(spread(new), ["norm", "country"], "left")
    return d.select("raw", "country", "norm", "_seq", "stage",
                    F.when(F.col("stage") == "new", F.col("new_id")).otherwise(F.col("id")).alias("handler_id"))


def new_handlers(resolved: DataFrame) -> DataFrame:
    """Dimension rows to create for the names that no stage matched."""
    created = first_rows(resolved.filter("stage = 'new'"), ["handler_id"], F.col("_seq"))
    return created.select(F.col("handler_id").alias("id"), N.clean_display_name(F.col("raw")).alias("name"), "norm", "country")


def backfill_handlers(dim: DataFrame, resolved: DataFrame) -> DataFrame:
    """Country for handlers without one, and "Last, First" names cleaned once seen without a comma."""
    seen = resolved.filter("stage <> 'new'").groupBy(F.col("handler_id").alias("id")).agg(
        F.min_by("country", F.when(F.col("country") != "", F.col("_seq"))).alias("_country"),
        F.max(~F.contains("raw", F.lit(","))).alias("_plain"),
    )
    d = dim.join(spread(seen), "id", "left")
    clean = F.coalesce(F.col("_plain"), F.lit(False)) & F.contains("name", F.lit(","))
    return d.select(
        "id",
        F.when(clean, N.clean_display_name(F.col("name"))).otherwise(F.col("name")).alias("name"),
        "norm",
        F.when(F.coalesce("country", F.lit("")) == "", F.coalesce("_country", "country")).otherwise(F.col("country")).alias("country"),
    )


def backfill_entities(dim: DataFrame, incoming: DataFrame) -> DataFrame:
    """Breed, registered and call name from new variants.

    The longest known name fills an empty registered name, the shortest (two letters or more)
    replaces a longer or empty call name. ``incoming`` has ``id, name, breed, _seq``.
    """
    short = F.struct(F.length("name").alias("n"), F.col("_seq").alias("s"))
    long = F.struct((-F.length("name")).alias("n"), F.col("_seq").alias("s"))
    named = incoming.filter("name <> ''").groupBy("id").agg(
        F.min_by("name", short).alias("_short"), F.min_by("name", long).alias("_long"))
    breeds = incoming.filter("breed is not null").groupBy("id").agg(F.min_by("breed", "_seq").alias("_breed"))
    d = dim.join(spread(named), "id", "left").join(spread(breeds), "id", "left")
    call, reg = F.coalesce("call_name", F.lit("")), F.coalesce("registered_name", F.lit(""))
    known = F.filter(F.array(call, reg, F.col("_short"), F.col("_long")), lambda x: x.isNotNull() & (x != ""))
    pick = lambda better: F.aggregate(known, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull() | better(x, acc), x).otherwise(acc))
    shortest = pick(lambda x, acc: F.length(x) < F.length(acc))
    longest = pick(lambda x, acc: F.length(x) > F.length(acc))
    uneven = F.coalesce(F.length(longest) > F.length(shortest), F.lit(False))
    new_reg = F.when((reg == "") & uneven, longest).otherwise(F.col("registered_name"))
    fits = uneven & (F.length(shortest) >= 2)
    new_call = F.when(fits & (((call == "") & (shortest != F.coalesce(new_reg, F.lit("")))) | ((call != "") & (F.length(shortest) < F.length(call)))),
                      shortest).otherwise(F.col("call_name"))
    return d.select("id", new_call.alias("call_name"), new_reg.alias("registered_name"),
                    F.coalesce("breed", "_breed").alias("breed"), "size")


def derive_aliases(entities: DataFrame, alias: DataFrame) -> DataFrame:
    """New alias rows from the rotations of new handlers' names, where the alias is free."""
    d = entities.select("id", F.explode(N.name_rotations(F.col("norm"))).alias("alias_name"))
    free = d.join(spread(alias.select("alias_name")), "alias_name", "left_anti")
    return free.groupBy("alias_name").agg(F.min("id").alias("canonical_id")).withColumn("source", F.lit("Import"))


def derive_entity_aliases(variants: DataFrame, alias: DataFrame) -> DataFrame:
    """New call-name aliases from name variants that differ from the canonical name.

    ``variants`` has ``id, canonical, variant``.
    """
    d = variants.filter((F.lower("variant") != F.lower("canonical")) & (F.trim("variant") != ""))
    d = d.select("id", F.lower("variant").alias("alias_name"))
    free = d.join(spread(alias.filter("type = 'CallName'").select("alias_name")), "alias_name", "left_anti")
    return free.groupBy("alias_name").agg(F.min("id").alias("canonical_id")).withColumn(
        "type", F.lit("CallName")).withColumn("source", F.lit("Import"))


def add_alias(alias: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual aliases (J19): the new table, and the rows refused because their name is taken."""
    fresh = first_rows(rows, ["alias_name"], F.col("canonical_id")).join(alias.select("alias_name"), "alias_name", "left_anti")
    refused = rows.join(fresh.select("alias_name", "canonical_id"), ["alias_name", "canonical_id"], "left_anti")
    return alias.unionByName(fresh.withColumn("source", F.lit("Manual")).select(alias.columns)), refused


# ---------------------------------------------------------------- entities of a handler


def _word_list(name: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(name, r"(?U)[^\w]+", " "), " "), lambda w: w != "")


def near_names(asked: DataFrame, mine: DataFrame) -> DataFrame:
    """Rows of asked (handler_id, size, name) with the rows of mine (handler_id, own_size, own_name) of the same handler, same or adjacent size,
    and the same name or one whose words stand inside the other.

    The words of a contained name are a run of the words of the longer one, so its longest word is among them: candidates come from an equality join
    on that word, both ways round, and every name is exploded into its distinct words at most.
    """
    word = lambda c: F.array_max(F.transform(_word_list(F.col(c)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    words = lambda c: F.explode(F.array_distinct(_word_list(F.col(c))))
    key = ["handler_id", "w"]
    inside = asked.withColumn("w", word("name")).join(spread(mine.withColumn("w", words("own_name"))), key)
    around = asked.withColumn("w", words("name")).join(spread(mine.withColumn("w", word("own_name"))), key)
    return inside.unionByName(around).filter(
        N.size_compatible(F.col("size"), F.col("own_size"))
        & ((F.col("name") == F.col("own_name")) | N.word_contained(F.col("name"), F.col("own_name"))))


def entity_names(rows: DataFrame) -> DataFrame:
    """One row per (handler_id, raw, size): the first ``_seq``, the cleaned name, and the normalized full, call and registered name."""
    d = first_rows(rows.select("handler_id", "raw", "size", "_seq"), ["handler_id", "raw", "size"], F.col("_seq"))
    clean = N.clean_entity_name(F.col("raw"))
    d = d.withColumn("clean", clean).withColumn("_x", N.extract_call_name(F.col("clean")))
    return d.select("handler_id", "raw", "size", "_seq", "clean", N.normalize_name(F.col("clean")).alias("full"),
                    F.when(F.col("_x.call_name").isNotNull(), N.normalize_name(F.col("_x.call_name"))).alias("call"),
                    F.when(F.col("_x.registered_name").isNotNull(), N.normalize_name(F.col("_x.registered_name"))).alias("reg"))


def name_tries(d: DataFrame) -> DataFrame:
    """The names to look for, in their order: call name, full name, registered name."""
    tries = F.array_compact(F.array(
        F.when(F.col("call").isNotNull(), F.struct(F.lit(1).alias("no"), F.col("call").alias("name"))),
        F.struct(F.lit(2).alias("no"), F.col("full").alias("name")),
        F.when(F.col("reg").isNotNull(), F.struct(F.lit(3).alias("no"), F.col("reg").alias("name"))),
    ))
    return d.select("handler_id", "size", "_seq", F.explode(tries).alias("t")).select("handler_id", "size", "_seq", "t.no", "t.name")


def resolve_entities(rows: DataFrame, dim: DataFrame, owned: DataFrame, alias: DataFrame) -> DataFrame:
    """Entity id and deciding stage per distinct (handler_id, raw, size).

    Stages: own alias, own exact name and size, own fuzzy name (whole words or same name, same or
    adjacent size, exactly one), global alias or name if the name is specific (more than ten
    letters), new. ``owned`` has ``handler_id, id``; ``dim`` has ``id, call_norm, reg_norm, size``.
    """
    d = materialize(entity_names(rows), "entities")
    v = name_tries(d)
    own = owned.select("handler_id", "id").distinct()
    called = alias.select(F.col("alias_name").alias("name"), F.col("canonical_id").alias("id"))
    named = dim.select("id", "size", F.explode(F.array_distinct(F.array("call_norm", "reg_norm"))).alias("name")).filter("name <> ''")
    mine = own.join(spread(dim.select("id", F.col("size").alias("own_size"), "call_norm", "reg_norm")), "id")
    mine = mine.select("handler_id", "id", "own_size", F.explode(F.array_distinct(F.array("call_norm", "reg_norm"))).alias("own_name")).filter("own_name <> ''")
    # Own records are met by handler and name, elsewhere only the lowest id of a name can be hit: a name that everybody uses lists no pairs.
    hits = {
        "own_alias": v.join(spread(own.join(spread(called), "id")), ["handler_id", "name"]),
        "own_exact": v.join(spread(mine.select("handler_id", "id", F.col("own_size").alias("size"), F.col("own_name").alias("name"))), ["handler_id", "size", "name"]),
        "any_alias": v.join(spread(called.groupBy("name").agg(F.min("id").alias("id"))), "name"),
        "any_exact": v.join(spread(named.groupBy("name", "size").agg(F.min("id").alias("id"))), ["name", "size"]),
    }
    kinds = [d.select("_seq", "no", "id", F.lit(kind).alias("kind")) for kind, d in hits.items()]
    hits = reduce(DataFrame.unionByName, kinds).groupBy("_seq").agg(
        *[F.min_by("id", F.when(F.col("kind") == kind, F.struct("no", "id"))).alias(kind) for kind in hits])
    near = near_names(v.filter(F.length("name") >= 3), mine)
    near = near.select("_seq", "id").distinct().groupBy("_seq").agg(
        F.count(F.lit(1)).alias("_n"), F.min("id").alias("fuzzy")).filter("_n = 1").drop("_n")
    d = d.join(spread(hits), "_seq", "left").join(spread(near), "_seq", "left")
    specific = (F.length("full") > 10) | (F.length(F.coalesce("reg", F.lit(""))) > 10)
    world = F.when(specific, F.coalesce("any_alias", "any_exact"))
    stage = (
        F.when(F.col("own_alias").isNotNull(), "own alias").when(F.col("own_exact").isNotNull(), "own exact")
        .when(F.col("fuzzy").isNotNull(), "own fuzzy").when(world.isNotNull(), "global").otherwise("new"))
    return d.withColumn("stage", stage).withColumn("id", F.coalesce("own_alias", "own_exact", "fuzzy", world)).select(
        "handler_id", "raw", "size", "_seq", "clean", "full", "call", "reg", "stage", "id")


def new_entities(resolved: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """Ids for unmatched entities: one per (handler, stored name, size); returns (rows with id, dimension rows).

    Without an explicit call name, three or more words count as a registered name.
    """
    new = resolved.filter("stage = 'new'")
    words = F.size(F.split("clean", " "))
    long = F.col("call").isNull() & (words >= 3)
    new = new.withColumn("call_norm", F.when(long, F.lit("")).otherwise(F.coalesce("call", "full"))).withColumn(
        "reg_norm", F.when(long, F.col("full")).otherwise(F.coalesce("reg", F.when(F.col("call").isNotNull(), F.col("full")), F.lit(""))))
    key = ["handler_id", "call_norm", "size", "_k"]
    new = new.withColumn("_k", F.when(F.col("call_norm") == "", F.col("reg_norm")).otherwise(F.lit("")))
    ids = new.groupBy(*key).agg(F.min("_seq").alias("_first"), F.min_by("reg_norm", "_seq").alias("reg"))
    ids = row_numbers(ids, [], [F.col("_first")], "_n").withColumn("id", F.col("_n") + top)
    rows = new.drop("id").join(spread(ids.select(*key, "id")), key).select(resolved.columns)
    return rows, ids.select("id", "handler_id", "call_norm", F.col("reg").alias("reg_norm"), "size")


def resolve_teams(pairs: DataFrame, teams: DataFrame, cfg: RatingConfig) -> DataFrame:
    """Team table with the missing (handler, entity) pairs added in the initial state."""
    fresh = pairs.select("handler_id", "entity_id").distinct().join(spread(teams), ["handler_id", "entity_id"], "left_anti")
    top = teams.agg(F.coalesce(F.max("team_id"), F.lit(-1))).first()[0]
    fresh = row_numbers(fresh, [], [F.col("handler_id"), F.col("entity_id")], "_n")
    return teams.unionByName(fresh.select(
        (F.col("_n") + top).alias("team_id"), "handler_id", "entity_id",
        F.lit(cfg.mu0).alias("mu"), F.lit(cfg.sigma0).alias("sigma")))


# ---------------------------------------------------------------- variants, recovery, merge


def recover_by_id(df: DataFrame) -> DataFrame:
    """Handler text from the id map of the file, fewest words win.

    Only rows that also name an entity teach the map.
    """
    filled = lambda c: F.coalesce(N.strip(F.col(c)), F.lit("")) != ""
    words = F.size(F.split(N.squeeze(F.col("handler")), " "))
    known = df.filter(filled("handler_id") & filled("handler") & filled("dog")).groupBy("file", "handler_id").agg(
        F.min_by(N.strip(F.col("handler")), F.struct(words, F.col("_seq"))).alias("_mapped"))
    d = df.join(known, ["file", "handler_id"], "left")
    return d.withColumn("handler", F.coalesce("_mapped", N.strip(F.col("handler")))).drop("_mapped").select(df.columns)


def recover_by_start_no(df: DataFrame) -> DataFrame:
    """Identity from the same start number in the same file, unless the number is ambiguous.

    The handler and entity of the last teaching row are taken; only rows with a handler id teach.
    """
    filled = lambda c: F.coalesce(N.strip(F.col(c)), F.lit("")) != ""
    teach = df.filter(filled("handler_id") & filled("handler") & filled("dog") & filled("start_no"))
    teach = teach.withColumn("_key", N.identity_key(F.col("handler"), F.col("dog")))
    known = teach.groupBy("file", "start_no").agg(
        F.min("_key").alias("_lo"), F.max("_key").alias("_hi"),
        F.max_by(F.struct("handler", "dog"), "_seq").alias("_who")).filter("_lo = _hi")
    d = df.join(known.select("file", "start_no", "_who"), ["file", "start_no"], "left")
    lost = (~filled("handler") | ~filled("dog")) & F.col("_who").isNotNull()
    return d.withColumn("handler", F.when(lost, F.col("_who.handler")).otherwise(F.col("handler"))).withColumn(
        "dog", F.when(lost, F.col("_who.dog")).otherwise(F.col("dog"))).select(df.columns)


def merge_variants(variants: DataFrame) -> DataFrame:
    """Map entity variants of one handler onto one of them (J12): ``handler, dog -> target``.

    ``variants`` has ``handler, dog, reg`` (reg null if unknown), many rows per (handler, dog).
    1. A call name of one or two words takes variants with more words whose first word it begins.
    2. Registered names with three equal words at the start (offset up to two) belong together.
    3. A one-word name that is a word of another variant's registered name takes that variant.
    Later rules only see variants that the earlier ones left alone. Inside rules 2 and 3 variants act in the order of (words, name): one that was taken takes
    nobody afterwards (``takers.first_takers``). Every rule is an equality join on a derived key followed by a minimum, so no pairs of a handler are listed.
    Chains are resolved by pointer jumping.
    """
    order = F.struct(F.size(F.split("dog", " ")).alias("n"), F.col("dog").alias("d"))
    dogs = materialize(variants.select("handler", "dog").distinct().withColumn("o", order), "variants")
    regs = materialize(variants.filter("reg is not null and reg <> ''").select("handler", "dog", "reg").distinct().withColumn("o", order), "registered")
    first = F.element_at(F.split("dog", " "), 1)
    # 1: the short name's first word is a beginning of the long name's first word
    short = dogs.filter("o.n <= 2 and dog <> ''").groupBy("handler", first.alias("p"), F.col("o.n").alias("n")).agg(F.min("o").alias("s"))
    begin = F.transform(F.sequence(F.lit(1), F.length(first)), lambda i: F.substring(first, F.lit(1), i))
    long = dogs.filter("o.n >= 2").select("handler", "dog", "o", F.explode(begin).alias("p"))
    step1 = long.join(short, ["handler", "p"]).filter("n < o.n").groupBy("handler", "dog").agg(F.min("s").alias("t"))
    step1 = materialize(step1.select("handler", "dog", F.col("t.d").alias("target")), "merge1")
    # 2: shared three-word run, at the start of at least one of the two names: leading runs meet all runs, all runs meet leading ones
    rest = regs.join(step1, ["handler", "dog"], "left_anti")
    runs = F.filter(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(i.alias("at"), F.slice(F.split("reg", " "), i, F.lit(3)).alias("run"))),
                    lambda x: F.size(x["run"]) == 3)
    grams = materialize(rest.select("handler", "o", F.explode(runs).alias("g")).select("handler", "o", "g.at", "g.run"), "runs")
    ends = {side: grams.filter(leads).select("handler", F.struct(F.lit(side).alias("side"), "run").alias("key"), "o")
            for side, leads in (("any", "true"), ("lead", "at = 1"))}
    side = F.struct(F.when(F.col("key.side") == "any", "lead").otherwise("any").alias("side"), "key.run")
    offers = ends["any"].unionByName(ends["lead"])
    step2 = _links(first_takers(offers, offers.withColumn("key", side)))
    done = materialize(step1.unionByName(step2), "merge2")
    # 3: a single word inside a registered name
    single = dogs.join(done, ["handler", "dog"], "left_anti").filter("o.n = 1 and dog <> ''").select("handler", F.col("dog").alias("key"), "o")
    inside = regs.join(done, ["handler", "dog"], "left_anti").select("handler", "dog", "o", F.explode(F.split("reg", " ")).alias("key")).filter("key <> dog")
    return resolve_chains(done.unionByName(_links(first_takers(single, inside))))


def _links(taken: DataFrame) -> DataFrame:
    return taken.select("handler", F.col("o.d").alias("dog"), F.col("taker.d").alias("target"))


def resolve_chains(links: DataFrame, by: Sequence[str] = ("handler",), name: str = "dog", to: str = "target") -> DataFrame:
    """Follow ``name -> to`` inside ``by`` to the end by pointer jumping: each round doubles the reach.

    After as many rounds as the number of links has binary digits every chain has ended; what still moves is a cycle, an error.
    """
    links = materialize(links, "links")
    reach, most = 1, None
    while True:
        ahead = links.select(*by, F.col(name).alias(to), F.col(to).alias("_next"))
        jumped = links.join(ahead, [*by, to], "left")
        moved = materialize(jumped.select(*by, name, F.coalesce("_next", to).alias(to), F.col("_next").isNotNull().alias("_moved")), "links")
        links = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return links
        most = links.count() if most is None else most
        reach *= 2
        if reach > 2 * most + 2:
            raise ValueError("links form a cycle")


def merge_entities(
    dim: DataFrame, teams: DataFrame, alias: DataFrame, pairs: DataFrame, key: str, *, same_size: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge source entities into targets (J15): teams and aliases move, the source goes, its name becomes an alias.

    ``pairs`` has ``source_id, target_id``, chains end at their last target; ``key`` is the team column of the entity. With
    ``same_size`` only pairs of one size are merged. For a dry run, look at the returned frames.
    """
    if same_size:
        sizes = dim.select("id", "size")
        pairs = (pairs.join(sizes.select(F.col("id").alias("source_id"), F.col("size").alias("_a")), "source_id")
                 .join(sizes.select(F.col("id").alias("target_id"), F.col("size").alias("_b")), "target_id")
                 .filter("_a = _b").select("source_id", "target_id"))
    pairs = resolve_chains(pairs.select("source_id", "target_id"), (), "source_id", "target_id")
    moved = pairs.select(F.col("source_id").alias(key), "target_id")
    t = teams.join(moved, key, "left").withColumn(key, F.coalesce("target_id", key)).select(teams.columns)
    a = alias.join(pairs.withColumnRenamed("source_id", "canonical_id"), "canonical_id", "left").withColumn(
        "canonical_id", F.coalesce("target_id", "canonical_id")).select(alias.columns)
    gone = dim.join(pairs, dim["id"] == pairs["source_id"]).select(
        F.col("name").alias("alias_name"), F.col("target_id").alias("canonical_id"), F.lit("Manual").alias("source"))
    rest = dim.join(pairs, dim["id"] == pairs["source_id"], "left_anti")
    return rest, t, a.unionByName(gone.select(alias.columns))


def collapse_teams(teams: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a merge: one team per (handler, entity) with the lowest id, results moved, one per run."""
    keep = teams.groupBy("handler_id", "entity_id").agg(F.min("team_id").alias("keep_id"))
    moves = teams.join(keep, ["handler_id", "entity_id"]).select("team_id", "keep_id")
    left = teams.join(keep.select(F.col("keep_id").alias("team_id")), "team_id", "left_semi")
    r = results.join(moves, "team_id").withColumn("team_id", F.col("keep_id")).select(results.columns)
    return left, first_rows(r, ["run_id", "team_id"], F.col("_seq"))


def delete_competition(slug: str, comps: DataFrame, runs: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without one competition."""
    gone = comps.filter(F.col("slug") == slug).select("comp_id")
    dead = runs.join(gone, "comp_id", "left_semi").select("run_id")
    return (comps.filter(F.col("slug") != slug), runs.join(gone, "comp_id", "left_anti"),
            results.join(dead, "run_id", "left_anti"))


def entities_of_handler(teams: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities per handler."""
    return teams.select("handler_id", "entity_id").distinct().join(
        entities.withColumnRenamed("id", "entity_id"), "entity_id")


def handlers_of_entity(teams: DataFrame, handlers: DataFrame) -> DataFrame:
    """Handlers per entity."""
    return teams.select("handler_id", "entity_id").distinct().join(
        handlers.withColumnRenamed("id", "handler_id"), "handler_id")


def aliases_of(entities: DataFrame, alias: DataFrame) -> DataFrame:
    """Aliases per entity."""
    return entities.select("id", "name").join(alias.withColumnRenamed("canonical_id", "id"), "id")


def update_country(dim: DataFrame, changes: DataFrame) -> DataFrame:
    """Country of the listed ids replaced (J18); ``changes`` has ``id, new_country``."""
    d = dim.join(changes, "id", "left")
    return d.withColumn("country", F.coalesce("new_country", "country")).select(dim.columns)


def resolve_judges(runs: DataFrame, judges: DataFrame, alias: DataFrame) -> DataFrame:
    """Judge id per distinct judge text: alias, exact, containment, new (J21). There is no country."""
    names = runs.filter("judge is not null").groupBy("judge").agg(F.min("_seq").alias("_seq"))
    none = F.lit("")
    return resolve_handlers(
        names.select(F.col("judge").alias("raw"), none.alias("country"), "_seq"),
        judges.select("id", "norm", none.alias("country")), alias,
    ).select(F.col("raw").alias("judge"), "norm", "stage", F.col("handler_id").alias("judge_id"))


def team_profiles(results: DataFrame) -> DataFrame:
    """Best display values per team (A8): handler text, call name, registered name, country.

    Texts with a comma win over others as handler name; the country of a handler's latest other
    team fills a missing one. Needs ``team, handler_key, handler, dog, country, _seq``.
    """
    p = N.parse_entity_name(F.col("dog"))
    d = results.withColumn("_p", p).select("*", "_p.call_name", "_p.registered_name").drop("_p")
    d = materialize(d, "profiles")
    score = lambda c: N.diacritics_score(F.col(c))

    def mode(value: str, source: DataFrame) -> DataFrame:
        counts = source.filter(F.coalesce(N.strip(F.col(value)), F.lit("")) != "").groupBy("team", N.strip(F.col(value)).alias("v")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_seq").alias("f"))
        best = F.struct((-F.col("n")).alias("n"), (-score("v")).alias("s"), F.col("f").alias("f"))
        return counts.groupBy("team").agg(F.min_by("v", best).alias(value))

    commas = d.filter(F.contains("handler", F.lit(","))).groupBy("team").agg(
        F.min_by(N.strip(F.col("handler")), F.struct(-score("handler"), F.col("_seq"))).alias("_comma"))
    reg = d.filter("registered_name <> ''").groupBy("team").agg(
        F.min_by("registered_name", F.struct(-F.length("registered_name"), F.col("_seq"))).alias("registered_name"))
    t = d.groupBy("team").agg(F.min("handler_key").alias("handler_key"), F.max("_seq").alias("_last"))
    t = (t.join(mode("handler", d), "team", "left").join(commas, "team", "left").join(mode("call_name", d), "team", "left")
         .join(reg, "team", "left").join(mode("country", d), "team", "left"))
    t = materialize(t, "profiled")
    filled = t.filter("country is not null").groupBy("handler_key").agg(F.max_by("country", "_last").alias("_fill"))
    t = t.join(filled, "handler_key", "left")
    empty = F.lit("")
    swapped = N.squeeze(F.regexp_replace("_comma", r"^([^,]*),(.*)$", "$2 $1"))
    call, registered = F.coalesce("call_name", empty), F.coalesce("registered_name", empty)
    return t.select(
        "team", F.coalesce(swapped, "handler").alias("handler_display"), call.alias("call_name"), registered.alias("registered_name"),
        N.entity_display(F.initcap(call), registered).alias("entity_display"), F.coalesce("country", "_fill", empty).alias("country"))
