"""Benchmark decontamination by template canonicalisation, in DataFrame and SQL functions alone.

Numbers, names and units of a text become typed placeholders; windows of template words are hashed
and joined with those of the benchmark.  A document whose windows follow an item's is checked slot
by slot: a value of the item must stand for one value of the document throughout, and no two for
the same, so the question may have been asked anew with other numbers or names, but not by chance.
A window also counts where its plain words are the document's, whatever their case, line breaks
and placeholders.

Documents meet distinct windows first.  A document that holds the asked share of an item holds one
of the item's rarest windows, so many enough of them; only for those pairs are all windows counted,
and a window that many items share doesn't multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, all_columns, checkpoint, is_small, keep_ids, texts

#: Words in a window, fewer only in items with fewer; a window with fewer than LITERAL words that
#: are no placeholders (or with any placeholder, if it is shorter) has no template to be held by.
WINDOW, LITERAL = 8, 4
#: Bytes of distinct windows that are broadcast.
KEY_BYTES = 4 * BROADCAST_BYTES
#: Share of an item's windows that a contaminated document holds.
COVERAGE = 0.5

# Unit words that may follow a number.
UNITS = "km cm mm kg mg lb lbs oz ml mph kmh mi m g l s h min mins sec secs hour hours minute minutes second seconds day days week weeks month months year years mile miles meter meters metre metres gram grams liter liters litre litres inch inches foot feet yard yards pound pounds dollar dollars euro euros cent cents percent degrees"

_NAME = r"\p{Lu}(?<=[\p{Ll},;:] \p{Lu})\p{L}*+"
_NUMBER = r"[0-9]++(?:[.,:][0-9]++)*+"
_UNIT = rf"(?<=§num )(?:{'|'.join(UNITS.split())})(?![\p{{L}}\p{{N}}])"
_BETWEEN = r"(?:[\x20\x09-\x0D]|[.,;:!?\"()|](?![0-9§]))+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BETWEEN), lambda w: w != "")


def _fold(text: Column) -> Column:
    """Lower case, with ``ss`` for ``ß``, which has no single upper-case letter."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def plain_words(text: Column) -> Column:
    """Lower-cased words with their numbers, names and units; the same places as in the template."""
    return _words(_fold(F.replace(text, F.lit("§"), F.lit("$"))))


def template_words(text: Column) -> Column:
    """Lower-cased words with ``§num``, ``§name`` and ``§unit`` in place of values."""
    t = F.regexp_replace(F.replace(text, F.lit("§"), F.lit("$")), _NAME, "§name")
    t = F.when(t.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(t, _NUMBER, "§num"), _UNIT, "§unit")).otherwise(t)
    return _words(_fold(t))


def _with_hashes(df: DataFrame, ks: list[int], **words: Column) -> DataFrame:
    """``df`` with, for each name of ``words`` and each k of ``ks``, ``name_k``: one hash of each run of k words.

    By doubling, with a projection for each step: an expression that stands in one twice would be
    computed twice.  For the same reason the hashes are exploded by an outer generator, under
    which the optimiser pushes no filter on them; rows without a hash go at the join.
    """
    rest = df.columns
    out = df.withColumns({f"{n}_1": w for n, w in words.items()}).withColumns({f"{n}_1": F.transform(f"{n}_1", lambda w: F.xxhash64(w)) for n in words})
    have, most = [1], max(ks)

    def add(k: int, half: int) -> None:
        nonlocal out

        def runs(name):
            x = f"{name}_{half}"
            n = F.greatest(F.size(x) - (k - half), F.lit(0))
            return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(k - half + 1), n), lambda a, b: F.xxhash64(a, b)).alias(f"{name}_{k}")

        keep = [f"{n}_{h}" for n in words for h in have if h in ks or h == half or 2 * h <= most]
        out = out.select(*rest, *keep, *(runs(n) for n in words))
        have.append(k)

    power = 1
    while 2 * power <= most:
        for k in sorted(ks):
            if power < k < 2 * power:
                add(k, power)
        add(2 * power, power)
        have = [h for h in have if h in ks or h == 2 * power]
        power *= 2
    for k in sorted(ks):
        if k not in have:
            add(k, power)
    return out.select(*rest, *(f"{n}_{k}" for n in words for k in ks))


def _windows(benchmark: DataFrame, k: int) -> DataFrame:
    """(item_id, k, at, forms, words, literal, slots, values, windows) of each window of each distinct item.

    Items of the same words are one, named by the smallest identifier.  ``forms`` is null where a
    window has too few literal words; such windows count only in items that have no other.
    """
    items = texts(benchmark, "item_id", "text").groupBy("doc_id").agg(F.max("text").alias("text")).select(F.col("doc_id").alias("item_id"), template_words(F.col("text")).alias("template"), plain_words(F.col("text")).alias("plain"))
    items = items.groupBy("template", "plain").agg(F.min("item_id").alias("item_id")).where(F.size("plain") > 0)
    items = checkpoint(items.withColumn("k", F.least(F.lit(k), F.size("plain"))))
    ks = sorted(r.k for r in items.select("k").distinct().collect())  # k values at most
    out = None
    for n in ks:
        hashed = _with_hashes(items.where(F.col("k") == n), [n], f=F.col("template"), w=F.col("plain"))
        part = hashed.select("item_id", "k", "template", "plain", F.posexplode_outer(F.arrays_zip(F.col(f"f_{n}").alias("f"), F.col(f"w_{n}").alias("w"))).alias("at", "hash"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = items.select("item_id", "k", "template", "plain", F.lit(0).alias("at"), F.lit(None).cast("struct<f:bigint,w:bigint>").alias("hash"))
    window = F.slice("template", F.col("at") + 1, F.col("k"))
    literal = F.size(F.filter(window, lambda w: ~w.startswith("§"))) >= F.least(F.lit(LITERAL), F.col("k"))
    slots = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.element_at("template", F.col("at") + i + 1).contains("§"))
    out = out.withColumn("literal", literal).withColumn("slots", slots).withColumn("values", F.transform("slots", lambda i: F.element_at("plain", F.col("at") + i + 1)))
    of_item = Window.partitionBy("item_id")
    out = out.withColumn("any", F.max("literal").over(of_item)).where("literal or not any").withColumn("windows", F.count("*").over(of_item))
    return checkpoint(out.select("item_id", "k", "at", F.when(F.col("literal"), F.col("hash.f")).alias("forms"), F.col("hash.w").alias("words"), "slots", "values", "windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, items, coverage) for each row of ``docs``.

    ``items`` are the ids, ascending, of benchmark items of whose windows the document holds at
    least ``coverage``, by their plain words or, in alignments with consistent slots, by their
    template; ``coverage`` is the largest such share, 0 without one.  Items of fewer than ``k``
    words are one window, the whole of them; items of the same words are one, named by the
    smallest identifier; items and texts that are null, empty or without words hold nothing.
    Rows that share an identifier share a result; rows without identifier are left out.
    """
    docs = texts(docs, id_col, text_col)
    windows = _windows(benchmark, k)
    ks = sorted(r.k for r in windows.select("k").distinct().collect()) or [k]

    # Plain words have no placeholder, so a window equals one of the same form, or is the same in both.
    keys = windows.select("k", F.col("forms").alias("hash"), "item_id", "at", F.size("slots").alias("n_slots")).where("hash is not null")
    keys = checkpoint(keys.unionByName(windows.where("forms is null or forms <> words").select("k", F.col("words").alias("hash"), "item_id", "at", F.lit(0).alias("n_slots"))))
    distinct = checkpoint(keys.select("k", "hash").distinct())
    seen = _with_hashes(docs.select("doc_id", "text"), ks, f=template_words(F.col("text")), w=plain_words(F.col("text")))
    if len(ks) == 1:
        seen = seen.select("doc_id", F.lit(ks[0]).alias("k"), F.col(f"f_{ks[0]}").alias("f"), F.col(f"w_{ks[0]}").alias("w"))
    else:
        seen = seen.select("doc_id", F.inline(F.array(*(F.struct(F.lit(n).alias("k"), F.col(f"f_{n}").alias("f"), F.col(f"w_{n}").alias("w")) for n in ks))))
    other = F.zip_with("f", "w", lambda a, b: F.when(a != b, b))
    seen = seen.select("doc_id", "k", F.greatest(F.size("f"), F.lit(1)).alias("n"), F.concat("f", other).alias("hashes"))
    seen = seen.select("doc_id", "k", "n", F.posexplode_outer("hashes").alias("place", "hash")).withColumn("place", F.col("place") % F.col("n"))
    hits = checkpoint(seen.join(F.broadcast(distinct) if is_small(distinct, KEY_BYTES) else distinct, ["k", "hash"]).select("doc_id", "place", "k", "hash").distinct())

    # Pairs that may reach the share: of W windows, one of the W - ceil(share * W) + 1 that fewest items have.
    common = keys.groupBy("k", "hash").agg(F.countDistinct("item_id").alias("items"))
    both = windows.select("item_id", "at", "windows").join(keys, ["item_id", "at"]).join(common, ["k", "hash"])
    rarity = both.groupBy("item_id", "at", "windows").agg(F.max("items").alias("items"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("items", "at"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("windows") * F.lit(coverage) - F.lit(1e-9)))
    rare = rarity.withColumn("rank", rank).where(F.col("rank") <= F.col("windows") - needed + 1).select("item_id", "at")
    rare = checkpoint(keys.join(rare, ["item_id", "at"], "left_semi").select("k", "hash", "item_id").distinct())
    pairs = hits.select("doc_id", "k", "hash").distinct().join(F.broadcast(rare) if is_small(rare) else rare, ["k", "hash"]).select("doc_id", "item_id").distinct()
    held = checkpoint(pairs.join(F.broadcast(keys) if is_small(keys) else keys, "item_id").join(hits, ["doc_id", "k", "hash"]).select("doc_id", "place", "item_id", "at", "n_slots", (F.col("place") - F.col("at")).alias("shift")))

    # Slot values of the documents that need them: a value of the item stands for one of the document, and back.
    asked = held.where("n_slots > 0")
    with_text = keep_ids(docs, asked.select("doc_id").distinct(), "semi").select("doc_id", plain_words(F.col("text")).alias("plain"))
    values = windows.where(F.size("slots") > 0).select("item_id", "at", F.explode(F.arrays_zip("slots", "values")).alias("slot"))
    stands = asked.join(values, ["item_id", "at"]).join(with_text, "doc_id").select("doc_id", "item_id", "shift", F.col("slot.values").alias("value"), F.get("plain", F.col("place") + F.col("slot.slots")).alias("found")).distinct()
    stands = checkpoint(stands)
    aligned = ["doc_id", "item_id", "shift"]
    odd = [stands.groupBy(*aligned, side).agg(F.count("*").alias("n")).where("n > 1").select(*aligned) for side in ("value", "found")]
    good = asked.join(odd[0].unionByName(odd[1]).distinct(), aligned, "left_anti").select("doc_id", "item_id", "at")
    good = good.unionByName(held.where("n_slots = 0").select("doc_id", "item_id", "at"))

    share = good.groupBy("doc_id", "item_id").agg(F.countDistinct("at").alias("n")).join(windows.groupBy("item_id").agg(F.max("windows").alias("windows")), "item_id")
    share = share.select("doc_id", "item_id", (F.col("n") / F.col("windows")).alias("share")).where(F.col("share") >= coverage)
    found = checkpoint(share.groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"), F.max("share").alias("coverage")))
    out = docs.select("doc_id").join(F.broadcast(found) if is_small(found) else found, "doc_id", "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", (F.size(F.coalesce("items", none)) > 0).alias("contaminated"), F.coalesce("items", none).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item; columns as they were.

    Rows that share an identifier stay or go together; empty texts stay; repeated rows stay;
    rows without identifier go.
    """
    gone = checkpoint(contaminated(docs, benchmark).where("contaminated").select("doc_id").distinct())
    return keep_ids(docs.where("doc_id is not null"), gone, "anti").select(*all_columns(docs))


def op6_template_join(spark, sf_dir: str) -> DataFrame:
    """Every document, with the benchmark items it holds, as a comma-joined list."""
    out = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "contaminated", F.array_join("items", ",").alias("items"), F.round("coverage", 6).alias("coverage"))


def brute_force(docs: list[tuple[int, str]], benchmark: list[tuple[int, str]], k: int = WINDOW, coverage: float = COVERAGE) -> list[tuple[int, bool, str, float]]:
    """The definition on a few documents, for tests."""
    import regex

    def both(text):
        text = (text or "").replace("§", "$")
        t = regex.sub(r"(?<=[\p{Ll},;:] )\p{Lu}\p{L}*+", "§name", text)
        t = regex.sub(r"(?<=§num )(?:%s)(?![\p{L}\p{N}])" % "|".join(UNITS.split()), "§unit", regex.sub(_NUMBER, "§num", t))
        return [[w for w in regex.split(_BETWEEN, x.lower().replace("ß", "ss")) if w] for x in (t, text)]

    index, words, sizes, ks, known = {}, {}, {}, set(), set()
    for item, text in sorted((i, t) for i, t in benchmark if i is not None):
        t, p = both(text)
        if not p or (tuple(t), tuple(p)) in known:
            continue
        known.add((tuple(t), tuple(p)))
        n = min(k, len(p))
        literal = [sum(not x.startswith("§") for x in t[at : at + n]) >= min(LITERAL, n) for at in range(len(t) - n + 1)]
        ks.add(n)
        for at, enough in enumerate(literal):
            w = tuple(t[at : at + n])
            if enough:
                index.setdefault(w, []).append((item, at, [(i, p[at + i]) for i in range(n) if "§" in w[i]]))
            if enough or not any(literal):
                sizes[item] = sizes.get(item, 0) + 1
                words.setdefault(tuple(p[at : at + n]), []).append((item, at))
    out = []
    for doc, text in docs:
        t, p = both(text)
        held, meant, odd, found = {}, {}, set(), {}
        for n in ks:
            for place in range(len(t) - n + 1):
                for item, at, slots in index.get(tuple(t[place : place + n]), ()):
                    key = (item, place - at)
                    held.setdefault(key, set()).add(at)
                    for i, value in slots:
                        for pair in (("to", value, p[place + i]), ("from", p[place + i], value)):
                            if meant.setdefault((*key, *pair[:2]), pair[2]) != pair[2]:
                                odd.add(key)
                for item, at in words.get(tuple(p[place : place + n]), ()):
                    found.setdefault(item, set()).add(at)
        for (item, shift), ats in held.items():
            if (item, shift) not in odd:
                found.setdefault(item, set()).update(ats)
        share = {i: len(a) / sizes[i] for i, a in found.items() if len(a) / sizes[i] >= coverage}
        out.append((doc, bool(share), ",".join(map(str, sorted(share))), round(max(share.values(), default=0.0), 6)))
    return out
