"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions only.

Candidates are found by fixed expressions in every whole text.  The hash of each candidate
value is aggregated over the corpus by distinct repositories and owners: a value that more
than ``MAX_OWNERS`` owners or more than ``MAX_REPOS`` repositories have is a widely copied
example, any other one that looks like a key is live.  A value known as live from its context in one place is then found wherever it
stands bare, as a run of 8 or more characters of the assign alphabet, with dots or between
them; these are the spans that the method adds to the base ones.  Values without a letter or
without a digit are often plain words; they are left where more than ``MAX_OWNERS`` owners have
them bare.  (The SQL knows only bare runs of 16 or more with a letter, a digit and no dot.)

Text is scanned for candidates, which are checkpointed, and again for bare runs, whose hashes
meet those of live values (broadcast up to ``BROADCAST`` rows, else salted); only texts with a
hit are searched for places.  Counts by hash are built in steps of partial aggregation, and
values that very many rows have meet their verdict by broadcast.  Defined results: null text
is empty; a null owner or repository counts as one owner of its own; rows with equal id and
text get equal spans; very long texts are read whole; an empty table gives no rows; other
columns, whatever their names, are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm import textkit as tk

MAX_OWNERS, MAX_REPOS, MIN_DISTINCT = 2, 4, 6
#: Rows of a side that may be broadcast, and the salts of joins beyond that.
BROADCAST, SALTS = 100_000, 32
MATCHES = "array<struct<kind:string,i:int,gap:bigint,size:bigint,value:string>>"
KINDS = ("assign", "access", "hex", "bare")
# The expressions of the three base kinds, then that of bare values.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}+"
BARE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: Bare runs of every live value: between dots and with dots.
RUNS = {"plain": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}+", "dotted": r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,}+"}
EXAMPLE = r"(?i)example|changeme|placeholder|your[_-]?|x{6,}|dummy|0{8,}"


def _kind(kind: str, text: Column, pattern: str, group: int, guard: Column) -> Column:
    """Matches in order: kind, place in order, code points since the last match, whole match, value."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    each = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value")),
        lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(m["gap"]).cast("bigint").alias("gap"), F.length(m["whole"]).cast("bigint").alias("size"), m["value"].alias("value")),
    )
    return F.when(guard & text.rlike(pattern), each)


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...]) -> DataFrame:
    """A row for each document: its key, owner, repository and the matches of all kinds."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    # a necessary condition of each kind, cheaper than its expression
    sign = F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))
    found = [
        _kind("assign", t, ASSIGN, 1, sign),
        _kind("access", t, ACCESS, 0, F.contains(t, F.lit("AKIA"))),
        _kind("hex", t, HEX, 0, F.lit(True)),
        _kind("bare", t, BARE, 0, F.lit(True)),
    ]
    none = F.array().cast(MATCHES)
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(F.col(id_col), t).alias("key"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols)).alias("repo"),
        F.concat(*(F.coalesce(x, none) for x in found)).alias("found"),
    )


def bare_spans(texts: DataFrame, live: DataFrame, max_owners: int) -> DataFrame:
    """(doc_id, key, kind, start, end, live, owners, repos) of the live values (h, value, owners, repos) that stand bare in texts (doc_id, key, owner, text)."""
    t = F.col("text")
    plain, dotted = (F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in RUNS.values())
    runs = F.array_distinct(F.concat(plain, F.flatten(F.transform(dotted, lambda x: F.array(x, F.regexp_replace(x, r"\.+$", ""))))))
    rows = texts.select("doc_id", "key", "owner", F.explode(F.transform(runs, lambda x: F.xxhash64(x))).alias("h"))
    live = tk.materialize(live)
    if live.limit(BROADCAST + 1).count() <= BROADCAST:
        hits = rows.join(F.broadcast(live), "h")
    else:
        # common words are runs, too, so no run is dealt by its hash alone
        salted = live.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = rows.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"]).drop("salt")
    hits = tk.materialize(hits.distinct())
    wide = hits.select("value", "owner").distinct().groupBy("value").count().where(F.col("count") > max_owners).select("value")
    wide = wide.where(~(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")))
    values = hits.join(wide, "value", "left_anti").groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.map_from_entries(F.collect_set(F.struct("value", F.struct("owners", "repos")))).alias("values"))
    values = tk.small(tk.materialize(values), BROADCAST)
    hit = texts.join(values, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).dropDuplicates(["doc_id", "key"])
    each = F.concat(*(F.coalesce(_kind(k, t, p, 0, F.lit(True)), F.array().cast(MATCHES)) for k, p in RUNS.items()))
    each = hit.select("doc_id", "key", "values", F.explode(each).alias("m")).select("doc_id", "key", "values", "m.*")
    order = Window.partitionBy("doc_id", "key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("start", F.sum(F.col("gap") + F.col("size")).over(order) - F.col("size"))
    each = each.withColumn("value", F.explode(F.array_distinct(F.array("value", F.regexp_replace("value", r"\.+$", "")))))
    each = each.withColumn("n", F.element_at("values", F.col("value"))).where("n IS NOT NULL")
    return each.select("doc_id", "key", F.lit("bare").alias("kind"), "start", (F.col("start") + F.length("value")).alias("end"), F.lit(True).alias("live"), "n.owners", "n.repos").distinct()


def spans(found: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, kind, start, end, live, owners, repos) of all base spans and of the spans added; with ``texts``, of all bare runs."""
    one = F.explode("found").alias("m")
    rows = found.where(F.size("found") > 0).select("doc_id", "key", "owner", "repo", one).select("doc_id", "key", "owner", "repo", "m.*")
    # equal documents of one owner and repository give equal rows
    rows = rows.distinct()
    order = Window.partitionBy("doc_id", "key", "owner", "repo", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.sum(F.col("gap") + F.col("size")).over(order)
    rows = rows.withColumn("end", ended).withColumn("start", ended - F.col("size"))
    rows = rows.where(
        ((F.col("kind") == "assign") & (F.length("value") >= 8))
        | ((F.col("kind") == "access") & (F.col("size") >= 16))
        | ((F.col("kind") == "hex") & (F.col("size") >= 32))
        | ((F.col("kind") == "bare") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    ).withColumn("hash", F.sha2("value", 256))
    rows = tk.materialize(rows.select("doc_id", "key", "owner", "repo", "kind", "start", "end", "value", "hash"))
    looks = (F.size(F.array_distinct(F.filter(F.split("value", ""), lambda c: c != ""))) >= MIN_DISTINCT) & ~F.col("value").rlike(EXAMPLE)
    based = F.col("kind") != "bare"
    pairs = rows.groupBy("hash", "owner", "repo").agg(F.max(looks).alias("looks"), F.count("*").alias("n"), F.max(based).alias("based"))
    owners = pairs.groupBy("hash", "owner").agg(F.count_if("based").alias("repos"), F.max("looks").alias("looks"), F.sum("n").alias("n"))
    verdict = owners.groupBy("hash").agg(F.count_if(F.col("repos") > 0).alias("owners"), F.sum("repos").alias("repos"), F.max("looks").alias("looks"), F.sum("n").alias("n")).where("owners > 0")
    verdict = tk.materialize(verdict.select("hash", "owners", "repos", "n", (F.col("looks") & (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).alias("live")))
    judged = tk.join_hot(rows, verdict, ["hash"], "n", rows.count()).where(based | F.col("live"))
    if texts is not None:
        known = judged.where(based & F.col("live")).select(F.xxhash64("value").alias("h"), "value", "owners", "repos").distinct()
    judged = judged.select("doc_id", "key", "kind", "start", "end", "live", "owners", "repos")
    if texts is not None:
        judged = judged.union(bare_spans(texts, known, max_owners))
    return judged.distinct()


def _texts(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(id_col), t).alias("key"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), t.alias("text"))


def _by_document(found: DataFrame, max_owners: int, max_repos: int, texts: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    each = F.struct("start", place.alias("place"), "end", "kind", "live", "owners", "repos")
    return spans(found, max_owners, max_repos, texts).groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(each)).alias("s"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, most_owners, most_repos for every row.

    The last two are the most owners and repositories that a value among the row's spans has.
    """
    found = tk.materialize(candidates(docs, id_col, text_col, owner_col, repo_cols))
    per = _by_document(found, max_owners, max_repos, _texts(docs, id_col, text_col, owner_col))
    keys = found.select("doc_id", "key")
    # a bare span that overlaps a base one says nothing new
    base = F.filter("s", lambda x: x["kind"] != "bare")
    fresh = F.filter("s", lambda x: (x["kind"] != "bare") | ~F.exists(base, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda test: F.size(F.filter("s", test)).cast("bigint")
    per = per.select(
        F.col("doc_id").alias("d"), F.col("key").alias("k"),
        *(count(_is(k)).alias(f"n_{k}") for k in KINDS[:3]),
        told(base).alias("base"), told(fresh).alias("spans"),
        F.size(F.filter(fresh, lambda x: x["live"])).cast("bigint").alias("n_live"), F.size(F.filter(fresh, lambda x: ~x["live"])).cast("bigint").alias("n_example"),
        F.array_max(F.transform(fresh, lambda x: x["owners"])).alias("most_owners"), F.array_max(F.transform(fresh, lambda x: x["repos"])).alias("most_repos"),
    )
    joined = keys.join(per, keys["doc_id"].eqNullSafe(per["d"]) & (keys["key"] == per["k"]), "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return joined.select("doc_id", n("n_assign"), n("n_access"), n("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), n("n_live"), n("n_example"), n("most_owners"), n("most_repos"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live credential of every text replaced by ``mark``; examples stay.

    The columns are those of ``docs``; n_chars, if there is one, follows the text.
    """
    found = tk.materialize(candidates(docs, id_col, text_col, owner_col, repo_cols))
    d, k, s, i, key = tk.unused(docs, "d", "k", "s", "i", "key")
    live = spans(found, max_owners, max_repos, _texts(docs, id_col, text_col, owner_col)).where("live").groupBy(F.col("doc_id").alias(d), F.col("key").alias(k)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(s))
    live = tk.small(tk.materialize(live), BROADCAST)
    t = F.col(text_col)
    keyed = docs.withColumn(i, F.col(id_col).cast("bigint")).withColumn(key, F.xxhash64(F.col(id_col), F.coalesce(t, F.lit(""))))
    joined = keyed.join(live, F.col(i).eqNullSafe(F.col(d)) & (F.col(key) == F.col(k)), "left")
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        s, state,
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], t.substr((a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark))).alias("out"),
        ),
        lambda a: F.concat(a["out"], t.substr((a["at"] + 1).cast("int"), F.length(t))),
    )
    clean = F.when(F.col(s).isNull(), t).otherwise(cut)
    out = joined.withColumn(text_col, clean)
    if "n_chars" in docs.columns:
        size = F.when(F.col(s).isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", size)
    return out.select(*docs.columns)
