"""Personal data: known shapes, and terms that disclose them [native].

E-mail and IP addresses, card and phone numbers are found by pattern: the protected entities.  Information-theoretic
sanitisation goes further: a term is risky if knowing it reveals an entity.  Over the whole corpus, with N documents,
n(e) with the entity, n(t) with the term and n(t,e) with both, anywhere in the document, a term's disclosure is

    PMI(t; e) / IC(e) = log(N n(t,e) / (n(t) n(e))) / log(N / n(e)),

1 if the term never occurs without the entity, 0 if it tells nothing.  A term met with the entity in at least `support`
documents, and with as many different surroundings of the entity (the characters within `reach`, as far as the next span
of its kind, so that copies of one document don't count as many), is generalised if its disclosure reaches `generalise`, removed if it reaches `remove`:
wherever it stands in the documents that hold the entity.  Terms are words outside entities, of four characters or more
and without digits: shorter words, names among them, and numbers are never sanitised.

As n(t,e) is at most n(t) and at most n(e), a disclosure of d needs n(t) <= n(e)^d N^(1-d): pairs of commoner terms
are left out before they are made, and so are entities without the support.

Nulls count as empty texts; null ids are kept; repeated rows are scanned one by one (and count as one document in the
statistics of pairs); an empty table gives no rows; other columns are ignored.  Texts are scanned whole; positions are
code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm._common import BREAKS, MARK, OTHER, bound, id_and_text, park, spans_text, tagged, with_spans

#: The known shapes.  Possessive forms, so that long runs take linear time and no deep recursion; a match
#: starts where a run of its characters starts, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SIEVES = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
ARRAY = "array<struct<start:bigint,end:bigint,action:string>>"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    ds = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int"))
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.transform(ds, lambda d, i: F.when(i % 2 == 1, twice(d)).otherwise(d)), F.lit(0), lambda acc, d: acc + d)
    return total % 10 == 0


def _holds(kind: str, s: Column) -> Column:
    if kind == "ip":
        small = lambda p: p.rlike("^0*+[0-9]{0,3}$") & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(s, r"\."), small)
    n = F.length(digits(s))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(s))).otherwise(F.lit(False))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _kept(kind: str) -> Column:
    return F.filter(kind, lambda s: _holds(kind, s["value"]))


def _replaced(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("by")))


def base_spans(docs: DataFrame, reach: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, blank, th (the text's hash), and an array of (start, end, value, around) for each kind of KINDS.

    blank: the text, as long as before, with blanks for e-mail addresses, null if it has none.  The other kinds have no
    letters, so no term lies in them.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    for kind, pattern in KINDS.items():
        rows = with_spans(rows, "text", kind, pattern, SIEVES[kind], around=reach, blank="blank" if kind == "email" else None)
        rows = rows.withColumn(kind, _kept(kind))
    return rows.withColumn("th", F.xxhash64("text"))


def _held() -> Column:
    """The (entity, around) of a text's spans: around is the hash of what stands on either side of one."""
    one = lambda kind: F.transform(kind, lambda s: F.struct(F.xxhash64(F.lit(kind), F.lower(s["value"])).alias("entity"), s["around"]))
    return F.concat(*(one(k) for k in KINDS))


def _terms(text: str) -> Column:
    """A text's distinct words in lower case, each lowered by itself, as it is where places are sought."""
    words = F.array_distinct(F.split(F.translate(F.col(text), MARK, OTHER), f"[{BREAKS}]+"))
    return F.array_distinct(F.transform(words, F.lower))


def _is_term(term: Column) -> Column:
    return (F.length(term) >= 4) & ~term.rlike("[0-9]")


def disclosures(plain: DataFrame, found: DataFrame, texts: DataFrame, support: int, generalise: float) -> DataFrame:
    """th, entity, term, disclosure for the texts' pairs that have enough support and a disclosure of `generalise` at least.

    plain: text of all rows; found: doc_id, th, held, text and blank (null in rows without entity); texts: th, blank,
    each text with an entity once.
    """
    n = plain.count()
    # A document is an id with a text, so its counts can be added up over texts.
    held = found.select(F.xxhash64("doc_id", "th").alias("doc"), "th", F.explode("held").alias("h")).select("doc", "th", "h.*")
    entities = held.groupBy("entity").agg(F.countDistinct("doc").alias("n_e"), F.countDistinct("around").alias("n_around"))
    entities = entities.where((F.col("n_e") >= support) & (F.col("n_around") >= support)).drop("n_around")
    docs = held.groupBy("th", "entity").agg(F.countDistinct("doc").alias("docs"), F.collect_set("around").alias("around"))
    held = park(docs.join(entities, "entity"), "held")
    # An outer explode: from a plain one the optimizer infers a filter that would split every text a second time.
    words = plain.select(F.explode_outer(_terms("text")).alias("term"), F.lit(1).alias("k"))
    inside = found.where("text is not null").select(F.explode_outer(F.array_except(_terms("text"), _terms("blank"))).alias("term"), F.lit(-1).alias("k"))
    most = lambda n_e: F.pow(n_e.cast("double"), F.lit(generalise)) * F.lit(float(max(1, n)) ** (1 - generalise)) * (1 + 1e-9)
    top = held.agg(F.max("n_e")).first()[0] or 0
    counts = words.unionAll(inside).where(_is_term(F.col("term"))).groupBy("term").agg(F.sum("k").alias("n_t"))
    counts = park(counts.where((F.col("n_t") >= support) & (F.col("n_t") <= most(F.lit(top)))), "counts")
    own = texts.join(held.groupBy("th").agg(F.max("n_e").alias("most")), "th")
    own = own.select("th", "most", F.explode_outer(_terms("blank")).alias("term")).where(_is_term(F.col("term")))
    own = own.join(counts, "term").where(F.col("n_t") <= most(F.col("most"))).drop("most")
    met = park(own.join(held, "th").where(F.col("n_t") <= most(F.col("n_e"))), "met")
    # A text's documents are counted with the first of its surroundings.
    each = met.select("entity", "term", "n_t", "n_e", "docs", F.posexplode("around").alias("i", "around"))
    pairs = each.groupBy("entity", "term", "n_t", "n_e").agg(F.sum(F.when(F.col("i") == 0, F.col("docs"))).alias("n_te"), F.countDistinct("around").alias("n_around"))
    ic = F.log(F.lit(float(max(1, n))) / F.col("n_e"))
    pmi = F.log(F.lit(float(max(1, n))) * F.col("n_te") / (F.greatest("n_t", "n_te") * F.col("n_e")))
    pairs = pairs.where((F.col("n_te") >= support) & (F.col("n_around") >= support))
    pairs = pairs.select("entity", "term", F.when(ic > 0, F.greatest(F.lit(0.0), pmi / ic)).otherwise(F.lit(0.0)).alias("disclosure"))
    return met.select("th", "entity", "term").join(pairs.where(F.col("disclosure") >= generalise), ["entity", "term"])


def sanitise(docs: DataFrame, clean: bool = True, support: int = 2, generalise: float = 0.8, remove: float = 0.95, reach: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the kinds' spans, `terms` (start, end, action), and with `clean` text and clean_text, one row per row of docs.

    Spans are found in one pass over the texts and written, with the texts that hold an entity; all texts are read again
    for the terms' counts, and to be rewritten.
    """
    rows = base_spans(docs, reach, id_col, text_col)
    some = F.size("held") > 0
    found = rows.withColumn("held", _held()).select("doc_id", "th", *KINDS, "held", F.when(some, F.col("text")).alias("text"), F.when(some, F.coalesce("blank", F.translate("text", MARK, OTHER))).alias("blank"))
    found = park(found, "spans")
    texts = park(found.where("text is not null").groupBy("th").agg(F.first("blank").alias("blank")), "texts")
    plain = id_and_text(docs, id_col, text_col).select(F.coalesce("text", F.lit("")).alias("text"))
    risky = park(disclosures(plain, found, texts, support, generalise).groupBy("th", "term").agg(F.max("disclosure").alias("d")), "risky")
    # Near copies have the same terms over and over: files of a few MB hold millions of such rows, so none is broadcast by a file's size.
    wide = lambda table: table.hint("merge")
    # Every place of a text's risky terms.
    tokens = F.regexp_extract_all(F.translate("blank", MARK, OTHER), F.lit(f"[^{BREAKS}]++|[{BREAKS}]++"), F.lit(0))
    places = texts.join(wide(risky.select("th").distinct()), "th", "left_semi").select("th", F.posexplode(tokens).alias("i", "token"))
    upto = Window.partitionBy("th").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    places = places.withColumn("end", F.sum(F.length("token").cast("bigint")).over(upto))
    places = places.select("th", F.lower("token").alias("term"), (F.col("end") - F.length("token")).alias("start"), "end")
    hits = places.join(wide(risky), ["th", "term"])
    action = F.when(F.col("d") >= remove, "remove").otherwise("generalise")
    terms = hits.groupBy("th").agg(F.array_sort(F.collect_list(F.struct("start", "end", action.alias("action")))).alias("terms"))
    rows = rows.drop("blank") if clean else found.drop("held", "text", "blank")
    rows = rows.join(wide(park(terms, "terms")), "th", "left").withColumn("terms", F.coalesce("terms", F.expr(f"cast(array() as {ARRAY})")))
    return (rows.withColumn("clean_text", _cleaned()) if clean else rows).drop("th")


#: Texts are cut into pieces of so many characters, so that any place is found without a walk from the start.
PIECE = 1024


def _cut(pieces: Column, a: Column, b: Column) -> Column:
    """The characters [a, b) of a text that is cut into pieces."""
    i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    here = lambda k, at, n: F.substring(piece(k), (at % PIECE + 1).cast("int"), n.cast("int"))
    inside = F.array_join(F.slice(pieces, i + 2, F.greatest(F.lit(0), j - i - 1)), "")
    return F.when(b <= a, F.lit("")).when(i == j, here(i, a, b - a)).otherwise(F.concat(here(i, a, F.lit(PIECE)), inside, here(j, F.lit(0), b % PIECE)))


def _cleaned() -> Column:
    """The text with entities replaced by their kind, risky terms by [TERM] or nothing; overlapping spans count once."""
    spans = [_replaced(k) for k in KINDS]
    spans.append(F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("by"))))
    every = F.array_sort(F.concat(*spans))
    # Each span kept, with the end of what the spans before it cover.
    empty = F.expr("cast(array() as array<struct<from:bigint,start:bigint,by:string>>)")

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), s["start"].alias("start"), s["by"].alias("by"))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(more).alias("out"))

    def built(pieces: Column, kept: Column) -> Column:
        parts = F.transform(kept["out"], lambda s: F.concat(_cut(pieces, s["from"], s["start"]), s["by"]))
        return F.concat(F.array_join(parts, ""), _cut(pieces, kept["at"], F.length("text").cast("bigint")))

    kept = F.aggregate(every, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    both = F.struct(pieces.alias("pieces"), kept.alias("kept"))
    return F.when(F.size(every) == 0, F.col("text")).otherwise(bound(both, lambda x: built(x["pieces"], x["kept"])))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"), clean=False)
    base = F.concat(*(tagged(F.col(k), k, i, by_kind=True) for i, k in enumerate(KINDS)))
    return found.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.concat(base, tagged(F.col("terms"), "term", len(KINDS), by_kind=True))).alias("spans"),
        F.size("terms").cast("bigint").alias("n_terms"),
    )
