"""Personal data by bootstrapped contextual extraction.

Patterns find seeds whose form proves them: the four base kinds, and hexadecimal digests as secrets. Each seed induces two lexical
patterns: the word, and the two words, to its left, with what is attached to it (a quote, ``key=``). Patterns and the identifiers that
they stand before form a graph; rounds of aggregation score a pattern by the share of its identifiers that are known (times the
logarithm of their number) and take the identifiers of trusted patterns as known for the next round. In the end, identifiers
after a trusted pattern that look like its kind are further spans.
All of it is DataFrame expressions; regular expressions are possessive and offsets are summed by runs, so a text of very many
identifiers takes little more than time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattiq.llm import common
from lattiq.llm.common import let

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans: secrets are no base kind, so they count in ``spans`` only.
SPAN_KINDS = (*KINDS, "secret")

#: Fixed patterns of the contract, each started only where a match can begin, and never retried inside a run.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_B = common.BLANKS
#: Identifier-like: numbers with the separators of the base kinds, as whole words; any other word with a digit or an at sign.
_NUMBER = rf"(?<![^{_B}\"'(<\[{{=:])\+?+\(?+[0-9]++(?:[\x20().-]{{1,2}}+[0-9]++)*+(?![^{_B}.,;:!?)\]}}'\"*#$%&<>])"
_WORD = rf"(?<![^{_B}])[^{_B}0-9@]*+[0-9@][^{_B}]*+"
#: What may be attached to an identifier in front and behind.
_FRONT, _BEHIND = r"^(?:[A-Za-z_][A-Za-z_.-]{0,30}+[=:])?+[\"'(<\[{]*+", r"[.,;:!?)\]}'\"*#$%&<>]+$"
#: The form of a secret that is a seed.
_DIGEST = r"(?i)^(?=[a-f]*[0-9])(?=[0-9]*[a-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"

#: A pattern is trusted from so many known identifiers, and such a share of all its identifiers; so many rounds.
LEAST_KNOWN, LEAST_SHARE, ROUNDS = 3, 0.5, 2
#: Characters before a span that can be its pattern; spans in a run of the prefix sums, and how far back a run looks for those.
_LEFT, _RUN, _BACK = 80, 512, 40

_LIKE = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9]+(?:[.:][0-9]+){2,7}$",
    "card": r"^(?:[0-9][\x20-]?){11,18}[0-9]$",
    "phone": r"^\+?[0-9(](?:[\x20().-]{0,2}[0-9)]){6,17}$",
    "secret": r"^(?=.*[0-9])[A-Za-z0-9+/_=-]{16,}$",
}


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, x, left>> of all matches: start and end in code points, match, and the characters before it.

    A fold that appends copies what it has at each step; so offsets are summed within runs of matches, and over the runs.
    """
    length = lambda run: F.aggregate(run, F.lit(0), lambda n, p: n + p["g"] + F.length(p["x"]))
    tail = lambda run: F.right(F.array_join(F.transform(F.slice(run, F.greatest(F.size(run) - _BACK, F.lit(0)) + 1, F.lit(_BACK)), lambda p: F.concat(p["left"], p["x"])), ""), F.lit(_LEFT))
    no_heads, no_spans = F.array().cast("array<struct<at:int,tail:string>>"), F.array().cast("array<struct<s:int,e:int,x:string,left:string>>")

    def step(acc: Column, p: Column) -> Column:
        s = acc["at"] + p["g"]
        e = s + F.length(p["x"])
        left = F.right(F.concat(acc["tail"], p["left"]), F.lit(_LEFT))
        one = F.struct(s.alias("s"), e.alias("e"), p["x"].alias("x"), left.alias("left"))
        return F.struct(e.alias("at"), F.right(F.concat(left, p["x"]), F.lit(_LEFT)).alias("tail"), F.concat(acc["out"], F.array(one)).alias("out"))

    def head(acc: Column, h: Column) -> Column:
        now = F.struct((acc["now"]["at"] + h["at"]).alias("at"), h["tail"].alias("tail"))
        return F.struct(now.alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))

    def placed(runs: Column) -> Column:
        ends = F.transform(runs, lambda r: F.struct(length(r).alias("at"), tail(r).alias("tail")))
        start = F.struct(F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")).alias("now"), no_heads.alias("out"))
        heads = F.aggregate(ends, start, head, lambda acc: acc["out"])
        return F.flatten(F.zip_with(runs, heads, lambda r, h: F.aggregate(r, F.struct(h["at"].alias("at"), h["tail"].alias("tail"), no_spans.alias("out")), step, lambda acc: acc["out"])))

    def of_found(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda x, g: F.struct(x.alias("x"), F.length(g).alias("g"), F.right(g, F.lit(_LEFT)).alias("left")))
        runs = let(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _RUN)), lambda k: F.slice(p, (k * _RUN + 1).cast("int"), F.lit(_RUN))))
        return F.when(F.size(found) > 0, let(runs, placed)).otherwise(no_spans)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_found)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Of a string of 13 to 19 digits."""
    each = F.transform(F.split(F.reverse(x), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(x))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(x))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _patterns(left: Column) -> Column:
    """The one and the two words before a span, in lower case, with what is attached to it; those that are not there are left out."""
    word, gap = f"[^{_B}]++", f"[{_B}]++"
    some = [F.regexp_extract(left, rf"(?<![^{_B}]){(word + gap) * k}[^{_B}]*+$", 0) for k in (1, 2)]
    return F.filter(F.array(*[F.lower(F.regexp_replace(x, gap, " ")) for x in some]), lambda x: x != "")


def _that_holds(kind: str):
    return lambda m: _holds(kind, m["x"])


def _is_kind(kind: str):
    return lambda m: m["kind"] == kind


def _of_kind(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"), m["x"].alias("x"), _patterns(m["left"]).alias("patterns"))


def _bare(m: Column) -> Column:
    """A word without what is attached to it; a digest is a secret."""

    def without(front: Column) -> Column:
        s = m["s"] + F.length(front)
        patterns = _patterns(F.concat(m["left"], front))
        return let(F.regexp_replace(F.substr(m["x"], F.length(front) + 1), _BEHIND, ""), lambda x: F.struct(F.when(x.rlike(_DIGEST), F.lit("secret")).alias("kind"), s.alias("s"), (s + F.length(x)).alias("e"), x.alias("x"), patterns.alias("patterns")))

    return let(F.regexp_extract(m["x"], _FRONT, 0), without)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` (the base kinds' seeds by kind, then start) and ``words`` (identifier-like words, which may overlap seeds)."""
    t = F.coalesce(F.col(text), F.lit(""))
    digit, at = t.rlike("[0-9]"), F.contains(t, F.lit("@"))
    none = F.array().cast("array<struct<s:int,e:int,x:string,left:string>>")
    out = docs.withColumns({"__digit": digit, "__at": at})
    for kind, pattern, may in (("email", _EMAIL, F.col("__at")), ("ip", _IP, F.col("__digit")), ("card", _CARD, F.col("__digit")), ("phone", _PHONE, F.col("__digit") & F.contains(t, F.lit("+")))):
        out = out.withColumn(f"__{kind}", F.when(may, F.filter(_spans(t, pattern), _that_holds(kind))).otherwise(none))
    out = out.withColumn("base", F.concat(*[F.transform(f"__{k}", _of_kind(k)) for k in KINDS]))
    words = F.when(F.col("__digit") | F.col("__at"), _spans(t, f"{_NUMBER}|{_WORD}")).otherwise(none)
    out = out.withColumn("words", F.filter(F.transform(words, _bare), lambda m: m["x"].rlike("[0-9@]")))
    return out.drop("__digit", "__at", *(f"__{k}" for k in KINDS))


def free_words(rows: DataFrame) -> DataFrame:
    """(__row, b, kind, s, e, x, patterns): base spans (b true) and the words that overlap none, of rows with ``base`` and ``words``.

    A window over each text's spans in order, so that no word is compared with every seed."""
    tag = lambda b: lambda m: F.struct(F.lit(b).alias("b"), m["kind"].alias("kind"), m["s"].alias("s"), m["e"].alias("e"), m["x"].alias("x"), m["patterns"].alias("patterns"))
    every = rows.where(F.size("words") > 0).select("__row", F.explode(F.concat(F.transform("base", tag(True)), F.transform("words", tag(False)))).alias("m")).select("__row", "m.*")
    order = Window.partitionBy("__row").orderBy("s", "e", "b")
    before = F.max(F.when(F.col("b"), F.col("e"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("b"), F.col("s"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    every = every.withColumns({"__before": before, "__after": after})
    alone = (F.coalesce("__before", F.lit(0)) <= F.col("s")) & (F.coalesce(F.col("__after"), F.col("e")) >= F.col("e"))
    return every.where(F.col("b") | alone).drop("__before", "__after")


def trusted_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """From distinct (ctx, x, kind) edges, kind null where unknown: (ctx, kind, score) of the trusted patterns. Ties of score go to
    the last kind by name.

    A context that stands before a third of all identifiers is one row from each task before it meets the others. Each
    round's patterns are cut off by a table in the shared folder.
    """
    patterns = None
    like = F.coalesce(*[F.when((F.col("kind") == k) & F.col("x").rlike(p), F.lit(True)) for k, p in _LIKE.items()], F.lit(False))
    for _ in range(rounds):
        known = edges
        if patterns is not None:
            more = edges.where("kind is null").drop("kind").join(patterns, "ctx").where(like).select("x", F.col("kind").alias("found")).distinct()
            more = more.groupBy("x").agg(F.min("found").alias("found"))
            known = edges.join(more, "x", "left").withColumn("kind", F.coalesce("kind", "found"))
        per = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in SPAN_KINDS]
        counted = known.groupBy("ctx").agg(F.count("*").alias("n"), *per)
        by_kind = counted.select("ctx", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("f")) for k in SPAN_KINDS])).alias("k")).select("ctx", "n", "k.kind", "k.f")
        by_kind = by_kind.where((F.col("f") >= LEAST_KNOWN) & (F.col("f") >= LEAST_SHARE * F.col("n")))
        best = by_kind.groupBy("ctx").agg(F.max(F.struct((F.col("f") / F.col("n") * F.log2("f")).alias("score"), "kind")).alias("b"))
        patterns = common.written(best.select("ctx", "b.kind", "b.score"), "pii-patterns")
    return patterns


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, ``base`` and ``added``, arrays of (kind, s, e, x), by kind as listed and start.

    Null and empty texts have no spans. Repeated rows and null ids keep a row each; their identifiers count once in
    the pattern graph, as do those of copies. Spans are offsets of code points, end exclusive. ``added`` holds secrets known by
    their form, and what trusted patterns discover; none of them overlaps a base span.
    """
    rows = base_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), "__text").drop("__text")
    rows = common.written(rows.withColumn("__row", F.monotonically_increasing_id()), "pii-spans")  # ids are fixed by writing them
    spans = common.written(free_words(rows), "pii-words")
    edges = spans.select(F.explode("patterns").alias("ctx"), "x", "kind").groupBy("ctx", "x").agg(F.min("kind").alias("kind"))
    patterns = trusted_patterns(common.written(edges, "pii-edges"))
    words = spans.where("not b").drop("b")
    like = F.coalesce(*[F.when((F.col("found") == k) & F.col("x").rlike(p), F.lit(True)) for k, p in _LIKE.items()], F.lit(False))
    told = words.where("kind is null").withColumn("ctx", F.explode("patterns")).join(patterns.select("ctx", F.col("kind").alias("found"), "score"), "ctx").where(like)
    told = told.groupBy("__row", "s", "e", "x").agg(F.max(F.struct("score", "found"))["found"].alias("kind"))
    added = told.select("__row", "kind", "s", "e", "x").unionByName(words.where("kind is not null").select("__row", "kind", "s", "e", "x"))
    added = added.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct(_kind_no(F.col("kind")).alias("no"), "s", "e", "kind", "x"))).alias("added"))
    out = rows.select("doc_id", "__row", "base").join(added, "__row", "left")
    tidy = lambda b: F.struct(b["kind"].alias("kind"), b["s"].alias("s"), b["e"].alias("e"), b["x"].alias("x"))
    return out.select("doc_id", F.transform("base", tidy).alias("base"), F.transform(F.coalesce("added", F.expr("array()").cast(added.schema["added"].dataType)), tidy).alias("added"))


def _kind_no(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in SPAN_KINDS]), kind).cast("int")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda b: F.concat_ws(":", b["kind"], b["s"].cast("string"), b["e"].cast("string"))), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of all documents; null and empty texts have none, repeated rows repeat."""
    found = find_pii(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [F.size(F.filter("base", _is_kind(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    order = lambda b: F.struct(_kind_no(b["kind"]).alias("no"), b["s"].alias("s"), b["e"].alias("e"), b["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat("base", "added"), order))
    secrets = F.size(F.filter("added", _is_kind("secret"))).cast("bigint").alias("n_secret")
    return found.select("doc_id", *count, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"), secrets)
