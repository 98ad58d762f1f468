"""Secret scans by corpus-wide ownership, in DataFrame functions only.

Candidates are found in every whole text, with their spans in code points. Their
hashes are then counted over the corpus: distinct repositories and distinct owners
per hash. A value that many owners hold, or very many repositories, is a copied example; a value that looks
random and is not so widely copied is taken for a live credential. Besides the
three base kinds there is ``owned``: a long mixed run, a secret only because its
owner alone has it. Words, numbers and UUIDs joined to a path or slug are no such run, nor
is the address part of a URL, however far back it begins (what follows ``?`` is looked at).

A text is passed once per kind: the pieces between matches, and the matches, are its
parts in order, and each match is a row from then on. Running sums over a text's rows give their places, and
running largest and smallest places of base spans and URLs, in order of the starts, tell which
runs overlap one. So a text with very many candidates costs a sort of them, not their square.

Repeated rows are one repository's; a null text is the empty text, a null owner
or repository counts as one of its own, a null id is kept. Values leave the scan
only as SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import by_position, columns, documents, salted_join, staged

# The base patterns (the last two with their least length), in listed order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "owned"]

#: Long runs that may be credentials of any form.
OWNED = r"[A-Za-z0-9+/_-]{20,}"
# What the parts of paths and slugs look like: words, abbreviations, numbers, words with a short number.
ORDINARY = r"^(?:(?:[A-Z]?[a-z]+)*|[A-Z]+[a-z]*|[0-9]+|(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{1,4}|[0-9]{1,4}[A-Za-z]{1,3})$"
UUID = r"(?i)(^|[/_+-])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}($|[/_+-])"
URL = r"""(?i)(?:[a-z0-9+.-]://|www\.)[^\s?#=&@:<>"']*(?::[0-9]+/[^\s?#=&@:<>"']*)?"""
URL_KIND = 4
#: So many characters, or this share of them, are in parts of a run that look random.
RANDOM_CHARACTERS, RANDOM_SHARE = 16, 0.6
#: A hash with at least so many owners, or repositories of owners, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 100
#: A live-looking value has so many different characters, letters and digits among them.
LIVE_CHARACTERS = 8


_MATCHES_DDL = "array<struct<kind:int,i:int,gap:int,n:int,value:string>>"


def _matches(text: Column, kind: int, regex: str, group: int) -> Column:
    """Matches of one kind, leftmost and non-overlapping, in order: the characters before each, its length and its value."""
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    pieces = F.slice(F.split(text, regex, -1), 1, F.size(whole))
    each = F.transform(
        F.arrays_zip(pieces.alias("piece"), whole.alias("whole"), value.alias("value")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.cast("int").alias("i"), F.length(x["piece"]).alias("gap"), F.length(x["whole"]).alias("n"), x["value"].alias("value")
        ),
    )
    return F.when(text.rlike(regex), each.cast(_MATCHES_DDL)).otherwise(F.array().cast(_MATCHES_DDL))


def _live_looking(value: Column) -> Column:
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)


def _random_run(value: Column) -> Column:
    """True for a long run with random parts."""
    # Two UUIDs may share the mark between them, so they are taken out twice.
    plain = F.regexp_replace(F.regexp_replace(value, UUID, "$1$2"), UUID, "$1$2")
    parts = F.filter(F.split(plain, "[/_+-]"), lambda p: ~p.rlike(ORDINARY))
    n = F.length(F.array_join(parts, ""))
    return (n >= RANDOM_CHARACTERS) | (n >= RANDOM_SHARE * F.length(value))


def matched(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """``row_id, doc_id, text_hash, owner, repo, matches`` per row. Write it before use: ``row_id`` is made here."""
    rows = columns(docs, doc_id=id_col, text=text_col, owner=owner_col, repo=repo_col)
    text = F.coalesce("text", F.lit(""))
    rows = rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text.alias("text"), F.col("owner").cast("string"), F.col("repo").cast("string"))
    t = F.col("text")
    rows = rows.withColumns({"base": F.concat(_matches(t, 0, ASSIGN, 2), _matches(t, 1, ACCESS, 0), _matches(t, 2, HEX, 0)), "owned": _matches(t, 3, OWNED, 0)})
    # Where no run looks like a credential, neither runs nor URLs matter.
    some = F.exists("owned", lambda o: _live_looking(o["value"]) & _random_run(o["value"]))
    more = F.when(some, F.concat("owned", _matches(t, URL_KIND, URL, 0))).otherwise(F.array().cast(_MATCHES_DDL))
    return rows.select("row_id", "doc_id", F.xxhash64("text").alias("text_hash"), "owner", "repo", F.concat("base", more).alias("matches"))


def candidates(rows: DataFrame) -> DataFrame:
    """The candidates of ``matched`` rows: ``row_id, doc_id, text_hash, owner, repo, start, stop, kind, hash, live`` (looks random).

    A row's matches are put into places by running sums, a kind at a time, and ``owned`` runs that overlap
    a base span or begin in a URL's address are left out, by running largest and smallest places.
    """
    each = rows.select("row_id", "doc_id", "text_hash", "owner", "repo", F.explode("matches").alias("m")).select("row_id", "doc_id", "text_hash", "owner", "repo", "m.*")
    upto = Window.partitionBy("row_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("stop", F.sum(F.col("gap") + F.col("n")).over(upto).cast("int"))
    placed = placed.withColumn("start", F.col("stop") - F.col("n"))
    long_enough = F.when(F.col("kind") == 0, F.length("value") >= 8).when(F.col("kind") == 3, _live_looking(F.col("value")) & _random_run(F.col("value"))).otherwise(True)
    placed = placed.filter(long_enough)
    ordered = Window.partitionBy("row_id").orderBy("start", "kind")
    back, ahead = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow), ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    base, url = F.col("kind") < 3, F.col("kind") == URL_KIND
    before = F.coalesce(F.max(F.when(base, F.col("stop"))).over(back), F.lit(0))
    after = F.min(F.when(base, F.col("start"))).over(ahead)
    address = F.coalesce(F.max(F.when(url, F.col("stop"))).over(back), F.lit(0))
    placed = placed.select("*", before.alias("before"), after.alias("after"), address.alias("address"))
    apart = (F.col("before") <= F.col("start")) & (F.col("after").isNull() | (F.col("after") >= F.col("stop"))) & (F.col("address") < F.col("start") + 2)
    kept = placed.filter(base | ((F.col("kind") == 3) & apart))
    return kept.select("row_id", "doc_id", "text_hash", "owner", "repo", "start", "stop", "kind", F.sha2("value", 256).alias("hash"), _live_looking(F.col("value")).alias("live"))


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, n_owners, n_repos``: distinct owners, and distinct repositories of owners.

    ``candidates``: hash, owner, repo. Three aggregates, each combined before its shuffle.
    """
    repos = candidates.select("hash", "owner", "repo").distinct()
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("k"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("k").alias("n_repos"))


def classified(each: DataFrame) -> DataFrame:
    """Candidates with corpus counts: row_id, start, stop, kind, n_owners, n_repos, verdict.

    verdict: ``example`` (many owners, or very many repositories), ``live`` (looks random) or ``plain``.
    One hash may hold a third of all candidates: its rows are dealt to several parts.
    """
    copied = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOS)
    verdict = F.when(copied, "example").when(F.col("live"), "live").otherwise("plain")
    joined = salted_join(each, ownership(each), ["hash"], ["row_id", "start"])
    return joined.select("row_id", "start", "stop", "kind", "n_owners", "n_repos", verdict.alias("verdict"))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string")))
    return F.array_join(parts, ",")


def secret_spans(docs: DataFrame, **cols: str) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, its base spans, and all spans with verdicts.

    ``owned`` spans count only where the corpus says live; base spans always stay.
    """
    rows = staged(matched(docs, **cols), "secret-matches")
    each = staged(candidates(rows), "secret-candidates")
    kept = classified(each).filter("kind < 3 or verdict = 'live'")
    per_row = kept.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "verdict"))).alias("spans"),
        F.count_if(F.col("verdict") == "live").alias("n_live"),
        F.count_if(F.col("verdict") == "example").alias("n_example"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,verdict:string>>")
    out = rows.select("row_id", "doc_id", "text_hash").join(per_row, "row_id", "left").withColumn("spans", F.coalesce("spans", none))
    return out.select(
        "doc_id", "text_hash", F.filter("spans", lambda x: x["kind"] < 3).alias("base"), "spans",
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


#: Code points of the blocks that a text is cut into, so that a place in it is found without a walk from its start.
TEXT_BLOCK = 1024


def _piece(blocks: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` to before ``stop`` of a text in blocks."""
    first, last = (F.call_function("div", c, F.lit(TEXT_BLOCK)).cast("int") for c in (start, stop - 1))
    at = start % TEXT_BLOCK
    inside = F.substring(F.element_at(blocks, first + 1), at + 1, stop - start)
    between = F.array_join(F.slice(blocks, first + 2, last - first - 1), "")
    across = F.concat(F.substring(F.element_at(blocks, first + 1), at + 1, F.lit(TEXT_BLOCK)), between, F.substring(F.element_at(blocks, last + 1), F.lit(1), (stop - 1) % TEXT_BLOCK + 1))
    return F.when(stop <= start, F.lit("")).when(first == last, inside).otherwise(across)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mark: str = "<secret>", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span of a live credential replaced by ``mark``; all rows and columns stay.

    Widely copied examples are left as they are. ``length_col``, if given, follows the changed text.
    """
    spans = secret_spans(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=repo_col)
    live = spans.select("doc_id", "text_hash", F.filter("spans", lambda s: s["verdict"] == "live").alias("live")).filter(F.size("live") > 0)
    live = live.dropDuplicates(["doc_id", "text_hash"]).withColumn("row_id", F.monotonically_increasing_id())
    each = staged(live.select("row_id", "doc_id", "text_hash", F.explode("live").alias("s")).select("row_id", "doc_id", "text_hash", "s.*"), "live-spans")
    # What stays before each span; overlapping spans are one.
    before = Window.partitionBy("row_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("from", F.coalesce(F.max("stop").over(before), F.lit(0)))
    gap = F.when(F.col("start") >= F.col("from"), F.struct("from", F.col("start").alias("to")))
    kept = each.groupBy("row_id", "doc_id", "text_hash").agg(F.array_sort(F.collect_list(gap)).alias("__live"), F.max("stop").alias("__rest"))
    live = kept.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__live", "__rest")
    rows, where = by_position(docs)
    text = F.col(where[text_col])
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    parts = F.transform(F.array(blocks), lambda x: F.concat(
        F.array_join(F.transform("__live", lambda g: F.concat(_piece(x, g["from"], g["to"]), F.lit(mark))), ""), _piece(x, F.col("__rest"), F.length(text))
    ))
    clean = F.element_at(parts, 1)
    hit = F.col(where[id_col]).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__hash"))
    changed = F.col("__live").isNotNull()
    new = {where[text_col]: clean}
    if length_col:
        new[where[length_col]] = F.length(clean).cast(rows.schema[where[length_col]].dataType)
    named = [F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns]
    return rows.join(live, hit, "left").select(*named).toDF(*docs.columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document; owner and repository are the source and the document."""
    found = secret_spans(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
    )
