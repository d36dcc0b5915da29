"""Linking people to records of a directory: by their pages' addresses, by name and workplace, by a cascade of tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import values as V
from quillstream.operators.groups import written


def domain(url: Column) -> Column:
    """Host and port in lower case; null where there is none."""
    return F.nullif(F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))), F.lit(""))


def plain_url(url: Column) -> Column:
    return F.rtrim(F.lower(url), F.lit("/"))


def same_workplace(affiliation: Column, workplace: Column) -> Column:
    """One contains the other without regard to case, or the affiliation is the acronym of the workplace's longer words."""
    a, b = F.lower(F.coalesce(affiliation, F.lit(""))), F.lower(F.coalesce(workplace, F.lit("")))
    letters = F.filter(T.words(b), lambda w: w.rlike(r"^\p{L}{3,}$"))
    acronym = F.array_join(F.transform(letters, lambda w: F.left(w, F.lit(1))), "")
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | ((F.size(letters) > 0) & (a == acronym)))


def index(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records by name and by domain: (first, last) and domain each with the record and the number of records of that key.

    ``records``: handle, first, last, workplace, homepage; those without a homepage are in no index.
    """
    rows = records.where("homepage is not null and homepage <> ''").withColumn("record", F.struct("handle", "workplace", "homepage", F.lower(F.trim("last")).alias("last")))
    key = [F.lower(F.trim("first")).alias("first_key"), F.lower(F.trim("last")).alias("last_key")]
    names = rows.select(*key, "record")
    by_name = names.join(names.groupBy("first_key", "last_key").agg(F.count("*").alias("n")).hint("rebalance"), ["first_key", "last_key"])
    domains = rows.select(domain(F.col("homepage")).alias("domain"), "record").where("domain is not null")
    by_domain = domains.join(domains.groupBy("domain").agg(F.count("*").alias("n")).hint("rebalance"), "domain")
    return by_name, by_domain


def by_address(people: DataFrame, by_domain: DataFrame) -> DataFrame:
    """(id, handle) of people (id, last, urls) with a page on a record's domain and its last name; on a shared host the whole
    address must agree.  The join is by domain and last name, so a host that many share is no hot key."""
    shared = F.col("domain").isin(*V.SHARED_HOSTS)
    pages = people.select("id", F.lower("last").alias("last"), F.explode("urls").alias("url")).withColumn("domain", domain(F.col("url")))
    records = by_domain.select("domain", F.col("record.last").alias("last"), "record.handle", "record.homepage")
    met = pages.join(records, ["domain", "last"]).where(~shared | (plain_url(F.col("url")) == plain_url(F.col("homepage"))))
    return met.select("id", "handle").distinct()


#: Pairs of a name's people and records that one task gives out.
PAIRS = 1 << 22


def by_name(people: DataFrame, names: DataFrame) -> DataFrame:
    """(id, handle, confidence) of people (id, first, last, affiliation): the only record of the name is unique; of several,
    the only one of the same workplace is an affiliation_match; else all of them are ambiguous.

    What holds is found once for each name and affiliation.  Only what is given out is made, by the last join, and no
    pair of a person and a record is dealt again; a name's people are dealt in as many parts as their pairs are worth.
    """
    key = ["first_key", "last_key"]
    who = written(people.select("id", F.lower(F.trim("first")).alias("first_key"), F.lower(F.trim("last")).alias("last_key"), F.coalesce("affiliation", F.lit("")).alias("affiliation")))
    records = written(names.select(*key, "n", "record.handle", F.coalesce("record.workplace", F.lit("")).alias("workplace")))
    places = records.groupBy(*key, "n", "workplace").agg(F.count("*").alias("c"), F.min("handle").alias("handle"))
    met = who.groupBy(*key, "affiliation").agg(F.count("*").alias("m")).join(places, key).withColumn("fits", same_workplace(F.col("affiliation"), F.col("workplace")))
    fitting = met.groupBy(*key, "affiliation", "n", "m").agg(F.sum(F.when(F.col("fits"), F.col("c")).otherwise(0)).alias("n_fits"), F.min(F.when(F.col("fits"), F.col("handle"))).alias("handle"))
    told = written(fitting.select(*key, "affiliation", "n", "m", F.when((F.col("n") > 1) & (F.col("n_fits") == 1), F.col("handle")).alias("only")))
    one = who.join(told.where("only is not null"), [*key, "affiliation"]).select("id", F.col("only").alias("handle"), F.lit("affiliation_match").alias("confidence"))
    every = told.where("only is null")
    parts = every.groupBy(*key).agg(F.greatest(F.lit(1), F.least(F.sum("m"), F.ceil(F.sum("m") * F.max("n") / PAIRS))).cast("int").alias("parts"))
    sides = [who.join(every.select(*key, "affiliation"), [*key, "affiliation"]).join(parts, key).select("id", *key, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")), records.join(parts, key).select(*key, "n", "handle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))]
    # in a given number of partitions: small inputs of large results would be put together in a few tasks
    many = int(who.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (side.repartition(many, *key, "part") for side in sides)
    return one.unionByName(left.join(right, [*key, "part"]).select("id", "handle", F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("confidence")))


def linked(people: DataFrame, records: DataFrame) -> DataFrame:
    """(id, handle, match, confidence): by address where people have a page there, else by name.

    ``people``: id, first, last, affiliation, urls (array, may be null).  People without a page aren't linked.
    """
    names, domains = index(records)
    own = people.where(F.size(F.coalesce("urls", F.array())) > 0)
    first = written(by_address(own, domains)).select("id", "handle", F.lit("url_match").alias("match"), F.lit("unique").alias("confidence"))
    rest = own.join(first.select("id").distinct(), "id", "left_anti")
    return first.unionByName(by_name(rest, names).select("id", "handle", F.lit("exact_name").alias("match"), "confidence"))


def resolved(wanted: DataFrame, known: DataFrame, told: DataFrame) -> DataFrame:
    """(k, id, tier) of people to look up (k, first, last, identifier): by exact name, else by identifier, else the only
    known person of that last name and a compatible first name, else what ``told`` (k, id; null: none) says, else a
    new one (null).

    ``known``: id, first, last, identifier.  Of several of one name or identifier the least id counts.
    """
    name = ["first_key", "last_key"]
    keyed = lambda df: df.withColumn("first_key", F.lower(F.trim("first"))).withColumn("last_key", F.lower(F.trim("last")))
    people, sought = keyed(known), keyed(wanted)
    exact = people.groupBy(*name).agg(F.min("id").alias("id"))
    one = sought.join(exact, name).select("k", F.lit(1).alias("tier"), "id")
    numbers = people.where("identifier is not null").groupBy("identifier").agg(F.min("id").alias("id"))
    two = sought.where("identifier is not null").join(numbers, "identifier").select("k", F.lit(2).alias("tier"), "id")
    found = written(one.unionByName(two).groupBy("k").agg(F.min(F.struct("tier", "id")).alias("b")).select("k", "b.id", F.when(F.col("b.tier") == 1, "name").otherwise("identifier").alias("tier")))
    # compatible names begin with one letter; each name, however many have it, meets the others once
    letter = F.left(F.lower(F.get(T.name_words(T.text(F.col("first"))), F.lit(0))), F.lit(1))
    rest = written(sought.join(found, "k", "left_anti").select("k", "last_key", "first"))
    names = rest.select("last_key", "first").distinct().withColumn("letter", letter)
    others = people.groupBy("last_key", "first").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("letter", letter).withColumnRenamed("first", "other")
    near = names.join(others, ["last_key", "letter"]).where(T.compatible_names(F.col("first"), F.col("other"))).groupBy("last_key", "first").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    three = written(rest.join(near, ["last_key", "first"]).groupBy("k").agg(F.min("id").alias("id"), F.sum("n").alias("n")).where("n = 1").select("k", "id", F.lit("compatible").alias("tier")))
    said = told.where("id is not null").groupBy("k").agg(F.min("id").alias("id"))
    last = rest.join(three, "k", "left_anti").join(said, "k", "left").select("k", "id", F.when(F.col("id").isNotNull(), "told").otherwise("new").alias("tier"))
    return found.unionByName(three).unionByName(last)
