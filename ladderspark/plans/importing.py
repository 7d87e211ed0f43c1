"""Import of result files into the tables (O12) and its audit log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderspark.config import RatingConfig
from ladderspark.functions import names as N
from ladderspark.functions.names import strip
from ladderspark.functions.values import map_category
from ladderspark.operators import first_come as FC
from ladderspark.operators import identity as I
from ladderspark.operators.rounds import unique_slugs
from ladderspark.operators.scan import first_rows, row_numbers, spread
from ladderspark.operators.validate import DISCIPLINES, accept_or_reject, repair_rank, validate_results
from ladderspark.storage import commit_tables, materialize, read_tables, version


TABLES = ["competitions", "handlers", "handler_aliases", "entities", "entity_aliases", "teams", "runs", "results"]
COUNTS = ["handlers", "entities", "teams", "new_handlers", "new_entities", "new_teams"]


@dataclass
class ImportResult:
    """``tables`` holds all tables after the import, by the names of TABLES; ``log`` and ``messages`` are about this import alone."""

    tables: dict[str, DataFrame]
    log: DataFrame
    messages: DataFrame


def import_log(rows: DataFrame, errors: DataFrame, warnings: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per file: status, row count, resolved and new entities, number of messages.

    The messages themselves are a relation of their own (``messages`` of the import). A rejected file has no warnings.
    """
    def counted(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy("file").agg(F.count(F.lit(1)).alias(f"{name}_count"))

    d = rows.groupBy("file").agg(F.count(F.lit(1)).alias("row_count"))
    d = d.join(spread(counted(errors, "errors")), "file", "left").join(spread(counted(warnings, "warnings")), "file", "left").join(spread(counts), "file", "left")
    status = F.when(F.col("errors_count") > 0, "Rejected").when(F.col("warnings_count") > 0, "PartialWarning").otherwise("Success")
    return d.withColumn("status", status).na.fill(0)


def _new_entities(found: DataFrame, breeds: DataFrame) -> DataFrame:
    """Stored form of the created entities: display names like the normalized ones (three or more words without a call name are a registered name)."""
    d = found.filter("stage = 'new'").withColumn("_x", N.extract_call_name(F.col("clean")))
    call, registered = F.col("_x.call_name"), F.col("_x.registered_name")
    long = call.isNull() & (F.size(F.split("clean", " ")) >= 3)
    shown = F.when(long, F.col("clean")).otherwise(F.coalesce(registered, F.when(call.isNotNull(), F.col("clean"))))
    return d.select("id", "_seq", F.when(long, F.lit("")).otherwise(F.coalesce(call, "clean")).alias("call_name"), shown.alias("registered_name"), "size").join(spread(breeds), "_seq", "left")


def _with_slugs(d: DataFrame, text: Column, order: str, existing: DataFrame) -> DataFrame:
    slugged = unique_slugs(d.withColumn("_base", N.slugify(text)), "_base", order, existing.filter("slug is not null").select("slug"))
    return slugged.drop("_base")


def _nothing_accepted(rows: DataFrame, tables: dict[str, DataFrame], errors: DataFrame, warnings: DataFrame) -> ImportResult:
    """What the import of no rows gives: the stored tables, where only the names of an entity may fill each other, and the log."""
    none = errors.limit(0).select("file", F.lit(0).alias("id"), F.lit("").alias("name"), F.lit("").alias("breed"), F.lit(0).alias("_seq"))
    dogs = I.backfill_entities(tables["entities"].select("id", "call_name", "registered_name", "size", "breed"), none.drop("file"))
    dogs = dogs.join(spread(tables["entities"].select("id", "call_norm", "reg_norm")), "id")
    after = {
        "competitions": tables["competitions"].select("slug"), "handlers": tables["handlers"].select("id", "name", "norm", "country", "slug"),
        "entities": dogs.select("id", "call_name", "registered_name", "call_norm", "reg_norm", "breed", "size"),
        "handler_aliases": tables["handler_aliases"].select("alias_name", "canonical_id", "source"),
        "entity_aliases": tables["entity_aliases"].select("alias_name", "canonical_id", "type", "source"),
        "teams": tables["teams"].select("team_id", "handler_id", "entity_id", "slug", "mu", "sigma"), "runs": tables["runs"], "results": tables["results"],
    }
    warnings = warnings.join(spread(errors.select("file").distinct()), "file", "left_anti")
    counts = none.select("file", *[F.lit(0).cast("bigint").alias(c) for c in COUNTS])
    return ImportResult(after, import_log(rows, errors, warnings, counts), _messages(errors, warnings))


def _messages(errors: DataFrame, warnings: DataFrame) -> DataFrame:
    return errors.select(F.lit("error").alias("kind"), "file", "line", "message").unionByName(
        warnings.select(F.lit("warning").alias("kind"), "file", "line", "message"))


def import_results(rows: DataFrame, comps: DataFrame, tables: dict[str, DataFrame], cfg: RatingConfig) -> ImportResult:
    """Validate, create runs, resolve identities, write results, log.

    ``rows`` are string rows with ``file, slug, line, _seq``; ``comps`` gives ``slug, organization, comp_date``; ``tables`` the stored ones:
    competitions (slug), handlers (id, name, norm, country, slug), handler_aliases (alias_name, canonical_id, source), entities (id, call_name, registered_name, call_norm,
    reg_norm, breed, size), entity_aliases (with type), teams (team_id, handler_id, entity_id, slug, mu, sigma), and runs and results if there are any.
    All files are imported by one plan. A row sees what earlier rows created, by ``_seq``. A known or unknown competition rejects its file.
    """
    handlers, entities, teams = tables["handlers"], tables["entities"], tables["teams"]
    known = tables["competitions"]
    rows, errors = validate_results(rows)
    again = rows.join(spread(known.select("slug")), "slug", "left_semi").groupBy("file", "slug").agg(F.min("line").alias("line"))
    missing = rows.join(spread(comps.select("slug")), "slug", "left_anti").groupBy("file", "slug").agg(F.min("line").alias("line"))
    told = lambda d, text: d.select("file", "line", F.concat(F.lit("Competition '"), F.coalesce("slug", F.lit("")), F.lit(text)).alias("message"))
    errors = errors.select("file", "line", "message").unionByName(told(again, "' is already imported.")).unionByName(told(missing, "' is unknown."))
    errors = materialize(errors, "errors")
    fixed = repair_rank(rows)
    warnings = fixed.filter("warning is not null").select("file", "line", F.col("warning").alias("message"))
    ok = accept_or_reject(fixed, errors, known).join(spread(comps), "slug")
    ok = ok.withColumn("_m", map_category(F.col("organization"), F.col("size")))
    ok = materialize(ok.select("*", F.col("_m.mapped").alias("mapped"), F.col("_m.excluded").alias("excluded")).drop("_m"), "accepted")

    first = first_rows(ok, ["slug", "round_key"], F.col("_seq"))
    usable = first.filter(F.col("mapped").isNotNull() & F.lower("discipline").isin([d.lower() for d in DISCIPLINES]))
    skipped = first.filter("mapped is null").select("file", "line", F.concat(
        F.lit("Round '"), F.col("round_key"), F.lit("': size category '"), F.col("size"),
        F.when(F.col("excluded"), F.lit("' is excluded.")).otherwise(F.lit("' is unknown."))).alias("message"))
    if {"runs", "results"} <= tables.keys() and ok.isEmpty():
        return _nothing_accepted(rows, tables, errors, warnings)
    top_run = tables["runs"].agg(F.coalesce(F.max("run_id"), F.lit(0))).first()[0] if "runs" in tables else 0
    runs = row_numbers(usable, [], [F.col("slug"), F.col("round_key")], "_n").select(
        (F.col("_n") + top_run).alias("run_id"), "slug", "round_key", F.coalesce(F.col("date").try_cast("date"), F.col("comp_date")).alias("date"),
        F.coalesce(F.col("run_number").try_cast("int"), F.lit(1)).alias("run_number"), F.col("mapped").alias("size"),
        F.initcap("discipline").alias("discipline"), (F.lower("is_team_round") == "true").alias("is_team_round"), "judge",
        F.when(F.col("mapped") != F.col("size"), F.col("size")).alias("original_size"),
        *[strip(F.col(c)).try_cast("double").alias(c) for c in ("sct", "mct", "course_length") if c in usable.columns])
    runs = materialize(runs, "runs")

    rated = ok.filter("mapped is not null").join(spread(runs.select("slug", "round_key", "run_id")), ["slug", "round_key"])
    breed = F.nullif(strip(F.col("breed")), F.lit("")) if "breed" in rated.columns else F.lit(None).cast("string")
    filled = {c: F.coalesce(c, F.lit("")) for c in ("country", "handler", "dog")}
    rated = materialize(rated.withColumns({**filled, "breed": breed}), "rated")
    who, created, name_aliases = FC.resolve_handlers(rated.select(F.col("handler").alias("raw"), "country", "_seq"), handlers, tables["handler_aliases"])
    created = _with_slugs(created, F.col("name"), "id", handlers)
    slugs = handlers.select("id", "slug").union(created.select("id", "slug"))
    people = I.backfill_handlers(handlers.select("id", "name", "norm", "country").unionByName(created.drop("slug")), who).join(spread(slugs), "id")
    people = materialize(people.select("id", "name", "norm", "country", "slug"), "handlers")
    d = materialize(rated.join(spread(who.select(F.col("raw").alias("handler"), "country", "handler_id", F.col("stage").alias("handler_stage"))), ["handler", "country"]), "handled")
    owned = teams.select("handler_id", F.col("entity_id").alias("id"))
    call_names = tables["entity_aliases"].filter("type = 'CallName'")
    found, fresh, dog_aliases = FC.resolve_entities(d.select("handler_id", F.col("dog").alias("raw"), F.col("mapped").alias("size"), "_seq"), entities, owned, call_names)
    d = d.join(spread(found.select("handler_id", F.col("raw").alias("dog"), F.col("size").alias("mapped"), F.col("id").alias("entity_id"), F.col("stage").alias("entity_stage"))),
               ["handler_id", "dog", "mapped"])
    d = materialize(d, "identified")
    shown = _new_entities(found, d.select("_seq", "breed")).drop("_seq")
    norms = entities.select("id", "call_norm", "reg_norm").union(fresh.select("id", "call_norm", "reg_norm"))
    again = d.join(spread(found.select("handler_id", F.col("raw").alias("dog"), F.col("size").alias("mapped"), "clean")), ["handler_id", "dog", "mapped"])
    dogs = entities.select("id", "call_name", "registered_name", "size", "breed").unionByName(shown)
    dogs = I.backfill_entities(dogs, again.select(F.col("entity_id").alias("id"), F.col("clean").alias("name"), "breed", "_seq")).join(spread(norms), "id")
    dogs = materialize(dogs.select("id", "call_name", "registered_name", "call_norm", "reg_norm", "breed", "size"), "dogs")
    all_teams = materialize(I.resolve_teams(d.select("handler_id", "entity_id"), teams.drop("slug"), cfg), "teams")
    named = all_teams.join(spread(teams.select("team_id")), "team_id", "left_anti").join(spread(people.select(F.col("id").alias("handler_id"), "name")), "handler_id").join(spread(
        dogs.select(F.col("id").alias("entity_id"), "call_name")), "entity_id")
    named = _with_slugs(named, F.concat_ws(" ", "name", "call_name"), "team_id", teams)
    team_slugs = teams.select("team_id", "slug").union(named.select("team_id", "slug"))
    d = d.join(spread(all_teams.select("handler_id", "entity_id", "team_id")), ["handler_id", "entity_id"])
    d = d.withColumn("out", F.lower(strip(F.col("eliminated"))) == "true")
    results = first_rows(d.select(
        "run_id", "team_id", "_seq", "file", F.when(~F.col("out"), strip(F.col("rank")).try_cast("int")).alias("rank"), F.col("out").alias("eliminated"),
        *[F.col(c).try_cast("double").alias(c) for c in ("faults", "refusals", "time_faults", "total_faults", "time", "speed")],
        *[F.nullif(strip(F.col(c)), F.lit("")).alias(c) for c in ("start_no",) if c in d.columns],
    ), ["run_id", "team_id"], F.col("_seq"))
    new_team = all_teams.join(spread(teams.select("team_id")), "team_id", "left_anti").select("team_id", F.lit(1).alias("_new"))
    counts = d.join(spread(new_team), "team_id", "left").groupBy("file").agg(
        F.count_distinct("handler_id").alias("handlers"), F.count_distinct("entity_id").alias("entities"), F.count_distinct("team_id").alias("teams"),
        F.count_distinct(F.when(F.col("handler_stage") == "new", F.col("handler_id"))).alias("new_handlers"),
        F.count_distinct(F.when(F.col("entity_stage") == "new", F.col("entity_id"))).alias("new_entities"),
        F.count_distinct(F.when(F.col("_new") == 1, F.col("team_id"))).alias("new_teams"))
    warnings = warnings.unionByName(skipped).join(spread(errors.select("file").distinct()), "file", "left_anti")
    log = import_log(rows, errors, warnings, counts)
    after = {
        "competitions": known.select("slug").union(ok.select("slug").distinct()), "handlers": people, "entities": dogs,
        "handler_aliases": tables["handler_aliases"].select("alias_name", "canonical_id", "source").union(name_aliases.select("alias_name", "canonical_id", "source")),
        "entity_aliases": tables["entity_aliases"].select("alias_name", "canonical_id", "type", "source").union(
            dog_aliases.select("alias_name", "canonical_id", F.lit("CallName"), "source")),
        "teams": all_teams.join(spread(team_slugs), "team_id").select("team_id", "handler_id", "entity_id", "slug", "mu", "sigma"),
        "runs": tables["runs"].unionByName(runs, allowMissingColumns=True) if "runs" in tables else runs,
        "results": tables["results"].unionByName(results, allowMissingColumns=True) if "results" in tables else results,
    }
    return ImportResult(after, log, _messages(errors, warnings))


def import_files(spark: SparkSession, root: str, rows: DataFrame, comps: DataFrame, cfg: RatingConfig) -> ImportResult:
    """Import into the tables stored under root and commit all of them at once; a commit of somebody else meanwhile is an error and changes nothing."""
    at = version(spark, root)
    done = import_results(rows, comps, read_tables(spark, root), cfg)
    commit_tables(spark, root, done.tables, based_on=at)
    return ImportResult(read_tables(spark, root), done.log, done.messages)
