"""Personal data by candidate generation and gradient-boosted selection, in SQL functions alone.

Generators with high recall propose overlapping spans: the four base kinds (rules decide those),
looser forms of phone, account and identity numbers and spelled-out addresses, and secrets:
assigned values, long keys, keys with a known beginning.  Boosted trees score a looser span by its
format and the text beside it; a threshold for each generator, calibrated on examples set aside,
selects it.  The trees become one SQL expression, so texts never leave the JVM.

No table labels personal data, so the trees are fitted on made spans of either class, set into
places of the documents' own text: at most CARRIERS documents lend one each.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .boosting import Trees, fit
from .common import checkpoint, texts

# The base patterns, written so that no run of characters is read more than once
# and no repetition recurses, however long the text; and the looser ones.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+A-Za-z])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])"
IDENTITY = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![0-9A-Za-z])"
SPELLED = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20(?:at|\[at\]|\(at\))\x20[A-Za-z0-9-]{1,63}(?:\x20(?:dot|\[dot\]|\(dot\))\x20[A-Za-z0-9-]{1,63}){1,4}"
NAMED = r"(?i:token|secret|passw(?:or)?d|passwd|pwd|passphrase|key|auth|bearer|credential)[\"']?\x20{0,2}[=:]{1,2}\x20{0,2}[\"']?"
ASSIGNED = NAMED + r"[^\x20\x09-\x0D\"',;<>()]{6,}+"
LONG_KEY = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}"
PREFIXED = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|xoxb-|xoxp-|eyJ)[A-Za-z0-9_.+/-]{12,}+"
DIGITS = r"(?<![0-9A-Za-z.,+-])[0-9]{8,18}+(?![0-9A-Za-z-])"

BEGINNINGS = "AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|xoxb-|xoxp-|eyJ"

#: (kind, pattern, what any text with a match holds: a string, or a pattern read once; whether that has digits).
GENERATORS = [
    ("email", EMAIL, "@", False), ("ip", IP, "[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]", True), ("card", CARD, "[0-9](?:[\\x20-]?[0-9]){11}", True), ("phone", PHONE, "+", True),
    ("phone", LOCAL_PHONE, "[0-9]{3}[\\x20.-][0-9]{3}", True), ("identity", IDENTITY, "[0-9]{3}-[0-9]{2}-[0-9]{4}", True), ("account", ACCOUNT, "[A-Z]{2}[0-9]{2}", True), ("email", SPELLED, "dot", False),
    ("secret", ASSIGNED, NAMED, False), ("secret", LONG_KEY, "(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20}", False), ("secret", PREFIXED, f"(?:{BEGINNINGS})[A-Za-z0-9_.+/-]{{12}}", False), ("account", DIGITS, "[0-9]{8}", True),
]
BASE, VALUE_OF = 4, 8
SIDE = 32
#: Documents that lend a place of their text to made examples.
CARRIERS = 500

# Words beside a span that speak for personal data, for a secret, and against either.
PERSON = r"(?i)(?:phone|tel|call|mobile|cell|fax|contact|reach|ssn|social|iban|account|acct|passport|konto|cuenta|compte|mail|write|whatsapp|sms|telefon|portable)[^\n]{0,16}$"
SECRET = r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|passphrase|key|auth|bearer|credential)[^A-Za-z\n]{0,6}$"
THING = r"(?i)(?:version|order|invoice|isbn|part|model|serial|page|room|item|ticket|build|ref|commit|sha1|sha256|md5|checksum|digest|hash|id|no\.|#|\$|/)[^A-Za-z\n]{0,8}$"
SPECIMEN = r"(?i)^(?:your|my|the|xxx|example|changeme|placeholder|none|null|true|false|env|os\.|process|https?:|[./~])"

#: Features: patterns counted in a span, then patterns looked for in its left side, itself, its right side.
COUNTS = {"digits": "[0-9]", "capitals": "[A-Z]", "smalls": "[a-z]", "vowels": "[aeiou]", "gaps": r"\x20", "dots": r"\.", "dashes": "[-_/]", "brackets": r"[()\[\]]", "turns": "[a-zA-Z][0-9]|[0-9][a-zA-Z]"}
LOOKS = {"near_person": ("left", PERSON), "near_secret": ("left", SECRET), "near_thing": ("left", THING), "quoted": ("left", "[\"']$"), "touched_left": ("left", "[A-Za-z0-9]$"), "alike": ("m", r"^(.)\1*$"), "hex": ("m", "^[0-9a-f]*$"), "specimen": ("m", SPECIMEN), "touched_right": ("right", "^[A-Za-z0-9%]")}
FEATURES = ["generator", "length", *COUNTS, *LOOKS]

_CANDIDATES = "array<struct<g:int,k:int,skip:bigint,m:string,left:string,right:string>>"


def _spans(text: Column, i: int) -> Column:
    """What generator ``i`` finds: the length of the text before each match, since the last, the match and its sides."""
    _, pattern, holds, digits = GENERATORS[i]
    found, apart = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.slice(apart, F.lit(1), F.size(found)).alias("before"), F.slice(apart, F.lit(2), F.size(found)).alias("after"))

    def one(x, k):
        m, before = x.m, x.before
        if i == VALUE_OF:  # the value alone; its name goes to the left
            m = F.regexp_replace(x.m, "^" + NAMED, "")
            before = F.concat(before, F.left(x.m, F.char_length(x.m) - F.char_length(m)))
        return F.struct(F.lit(i).alias("g"), k.alias("k"), F.char_length(before).cast("long").alias("skip"), m.alias("m"), F.right(before, F.lit(SIDE)).alias("left"), F.left(x.after, F.lit(SIDE)).alias("right"))

    may = text.rlike(holds) if set(holds) & set("[(?") else text.contains(holds)
    may = F.col("digits") & may if digits else may
    return F.when(may, F.transform(pairs, one)).otherwise(F.array().cast(_CANDIDATES))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: _luhn_part(F.substring(digits, i, F.lit(1)).cast("int"), F.length(digits) - i))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def _luhn_part(d: Column, from_end: Column) -> Column:
    return F.when(from_end % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)


def _base_rule() -> Column:
    """Whether a match of a base generator is personal data."""
    n = F.length(_digits(F.col("m")))
    parts = F.forall(F.split("m", r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    return F.when(F.col("g") == 0, True).when(F.col("g") == 1, parts).when(F.col("g") == 2, n.between(12, 19) & F.when(n.between(12, 19), luhn(_digits(F.col("m")))).otherwise(False)).when(F.col("g") == 3, n.between(9, 15)).otherwise(False)


def _features(df: DataFrame) -> DataFrame:
    """``df`` (g, m, left, right) with the features of each span."""
    counts = {n: F.regexp_count("m", F.lit(p)).cast("double") for n, p in COUNTS.items()}
    looks = {n: F.col(side).rlike(p).cast("double") for n, (side, p) in LOOKS.items()}
    return df.withColumns({"generator": F.col("g").cast("double"), "length": F.char_length("m").cast("double"), **counts, **looks})


def as_sql(trees: Trees) -> Column:
    """The margin of boosted trees as one expression over the feature columns."""

    def node(t: int, k: int, level: int) -> Column:
        if level == trees.depth:
            return F.lit(float(trees.leaf[t, k - (2**trees.depth - 1)]))
        if np.isinf(trees.cut[t, k]):  # no split: every row goes left
            return node(t, 2 * k + 1, level + 1)
        return F.when(F.col(FEATURES[trees.feature[t, k]]) > float(trees.cut[t, k]), node(t, 2 * k + 2, level + 1)).otherwise(node(t, 2 * k + 1, level + 1))

    out = F.lit(trees.base)
    for t in range(len(trees.feature)):
        out = out + node(t, 0, 0)
    return out


_FILLER = ["and then it was the same as before", "in the course of the day", "for all of them to see"]


def carriers(docs: DataFrame, most: int = CARRIERS) -> list[str]:
    """A place of each of at most ``most`` documents, chosen by a hash of the identifier; of rows that share one, by the place."""
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.char_length("text") - 64, F.lit(1))).cast("int")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = docs.select("doc_id").orderBy(*order).limit(most)
    places = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", F.substring("text", at + 1, F.lit(64)).alias("t"))
    got = places.orderBy(*order, "t").limit(most).collect()
    return sorted(r.t for r in got if len(r.t.split()) > 4) or _FILLER


def examples(places: list[str], n: int = 4800, seed: int = 5) -> list[tuple[int, str, str, str, int]]:
    """(generator, left, match, right, label): made spans as the looser generators propose them, in places of given text."""
    r = random.Random(seed)
    pick = lambda chars, a, z=None: "".join(r.choice(chars) for _ in range(r.randint(a, z or a)))
    d = lambda a, z=None: pick("0123456789", a, z)
    w = lambda: pick("aeioulnrst", 2, 8)
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    person = ["call ", "phone: ", "tel. ", "my mobile is ", "contact ", "SSN ", "social security number ", "IBAN ", "account ", "acct no ", "passport ", "write to ", "mail me: "]
    thing = ["version ", "order ", "invoice ", "ISBN ", "part ", "model ", "serial ", "page ", "item ", "ref ", "commit ", "sha256: ", "md5 ", "checksum ", "build ", "#", "id "]
    naming = ["token = ", "token: ", "api_key=", "secret = ", "password: ", "auth: ", "access key: ", "Bearer: "]
    slug = lambda sep, k: sep.join(w() for _ in range(k))
    out = []
    for _ in range(n):
        yes, g, ahead, after = r.random() < 0.5, r.randrange(BASE, len(GENERATORS)), "", " "
        around = r.choice(["", "", w() + " "])
        if g == 4:
            m = r.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(d(3), d(3), d(4)) if yes or r.random() < 0.3 else r.choice(["{} {} {}", "{}.{}.{}", "{}-{}-{}"]).format(d(2, 4), d(3), d(3))
            ahead = r.choice([*person, around]) if yes and m[0] == "(" else r.choice(person) if yes else r.choice([*thing, around])
        elif g == 5:
            m, ahead = f"{d(3)}-{d(2)}-{d(4)}", r.choice(person) if yes else r.choice([*thing, around])
        elif g == 6:
            m = r.choice(["DE", "FR", "ES", "GB"]) + d(2) + " ".join(d(4) for _ in range(r.randint(3, 5))) if yes else r.choice(["AB", "XR", "ZZ"]) + d(2) + pick("ABCDEF0123456789", 12)
            ahead = r.choice(person) if yes else r.choice([*thing, around])
        elif g == 7:
            m = f"{w()}.{w()} {r.choice(['at', '(at)', '[at]'])} {w()} {r.choice(['dot', '(dot)', '[dot]'])} {r.choice(['com', 'org', 'net'])}" if yes else f"{w()} at {w()} dot {w()}"
            ahead = r.choice(person) if yes else around
        elif g == 8:
            quote = r.choice(["", "", '"', "'"])
            ahead, after = r.choice(naming) + quote, quote + " "
            m = r.choice([pick(hexes, 24, 64), pick(mixed, 16, 48), pick(mixed, 4, 8) + r.choice("!#%&*") + d(2, 4)]) if yes else r.choice([w() + w() + w(), slug("-", 2), slug("_", 3), "your_" + slug("_", 2), "xxxxxxxx", "example-" + w(), "https://" + slug(".", 2), "./" + slug("/", 3), "os.environ", "placeholder", d(6, 9)])
        elif g == 9:
            m = r.choice([pick(hexes, 32, 64), pick(mixed, 24, 64)]) if yes or r.random() < 0.3 else r.choice([slug("-", 6), slug("_", 6), slug("/", 6), "-" * 30, "_" * 40, "/" * 24, "+-" * 16, w() * 8, d(20, 40), slug("-", 5) + "-" + d(4)])
            m = m if len(m) >= 20 else m + "-" + slug("-", 8)
            ahead = r.choice(naming) + r.choice(["", '"']) if yes else r.choice([*thing, around, around])
        elif g == 10:
            head = r.choice(["AKIA", "ghp_", "sk-", "sk_live_", "AIza", "xoxb-", "glpat-", "eyJ"])
            m = head + (pick(mixed, 16, 48) if yes else slug("-", 4) + slug("-", 2))
            ahead = r.choice([*naming, around, around]) if yes else around
        else:
            m, ahead = d(8, 18), r.choice(["account ", "acct no ", "IBAN ", "passport ", "konto ", "SSN "]) if yes else r.choice([*thing, around, around, around])
        place = r.choice(places)
        cut = place.find(" ", r.randrange(max(1, len(place) // 2))) + 1
        out.append((g, (place[:cut] + ahead)[-SIDE:], m, (after + place[cut:])[:SIDE], int(yes)))
    return out


def train(docs: DataFrame, precision: float) -> tuple[Trees, list[float]]:
    """Trees, and for each generator the least margin that keeps ``precision`` on examples set aside."""
    made = examples(carriers(docs))
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({g}, {quoted(left)}, {quoted(m)}, {quoted(right)}, {y})" for g, left, m, right, y in made)
    table = _features(docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(g, left, m, right, y)")).select(*FEATURES, "y").collect()
    x, y = np.array([[r[c] for c in FEATURES] for r in table]), np.array([r["y"] for r in table])
    aside = np.arange(len(y)) % 3 == 0
    trees = fit(x[~aside], y[~aside], n_trees=16, depth=3, rate=0.4)
    margin, least = trees.margin(x[aside]), [0.0] * BASE
    for g in range(BASE, len(GENERATORS)):
        mine = x[aside][:, 0] == g
        order = np.argsort(-margin[mine], kind="stable")
        m = margin[mine][order]
        right = np.cumsum(y[aside][mine][order]) / np.arange(1, len(m) + 1)
        good = np.flatnonzero((right >= precision) & np.append(m[1:] < m[:-1], True))
        least.append(float(m[good[-1]]) if len(good) else float("inf"))
    return trees, least


def find(docs: DataFrame, precision: float = 0.98, id_col: str = "doc_id", text_col: str = "text", model: tuple[Trees, list[float]] | None = None) -> DataFrame:
    """(doc_id, found) for each row of ``docs``: the spans in order of start and kind.

    ``found`` holds kind, start, end (code points, end exclusive) and base: whether a rule or the
    classifier selected it.  Base spans of different kinds may overlap.  A selected span that
    overlaps a base span goes; selected spans that overlap are one span, of the kind that
    scored highest.  Null and empty texts have no spans; rows that share an identifier are read
    each; rows without identifier are left out.
    """
    docs = texts(docs, id_col, text_col)
    trees, least = model or train(docs, precision)
    # Each step is written down: an optimiser that saw them as one would write the patterns out into every node of the trees.
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.col("text").rlike("[0-9]").alias("digits"))
    read = checkpoint(read.select("row", "doc_id", F.concat(*(_spans(F.col("text"), i) for i in range(len(GENERATORS)))).alias("each")))
    each = read.select("row", F.explode_outer("each").alias("e")).where("e is not null").select("row", "e.*")
    so_far = Window.partitionBy("row", "g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("skip") + F.char_length("m")).over(so_far)).withColumn("start", F.col("end") - F.char_length("m"))
    each = checkpoint(each.select("row", "g", "start", "end", "m", "left", "right"))
    base = each.where(F.col("g") < BASE).where(_base_rule()).select("row", "g", "start", "end", F.lit(True).alias("base"), F.lit(0.0).alias("margin"))
    measured = checkpoint(_features(each.where(F.col("g") >= BASE)).select("row", "g", "start", "end", *FEATURES))
    enough = F.element_at(F.array(*(F.lit(x) for x in least)), F.col("g") + 1)
    added = checkpoint(measured.select("row", "g", "start", "end", F.lit(False).alias("base"), as_sql(trees).alias("margin"))).where(F.col("margin") >= enough)
    both = checkpoint(base.unionByName(added))
    # How far base spans that begin before reach, and where the next begins; frames that only grow.
    order = [F.col("start"), F.desc("base"), F.col("g"), F.col("end")]
    back = [F.desc("start"), F.col("base"), F.desc("g"), F.desc("end")]
    before, after = (Window.partitionBy("row").orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (order, back))
    both = both.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(before)).withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(after))
    both = both.where("base or (coalesce(reach, 0) <= start and coalesce(next, end) >= end)")
    # Runs of selected spans that overlap.
    run = both.where("not base").withColumn("opens", (F.coalesce(F.max("end").over(before), F.lit(0)) <= F.col("start")).cast("int"))
    run = run.withColumn("run", F.sum("opens").over(Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    united = run.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.struct("margin", (-F.col("g")).alias("back")))["back"].alias("back"))
    both = both.where("base").select("row", "g", "start", "end", "base").unionByName(united.select("row", (-F.col("back")).alias("g"), "start", "end", F.lit(False).alias("base")))
    name = F.array(*(F.lit(g[0]) for g in GENERATORS))
    one = F.struct("start", "g", F.get(name, F.col("g")).alias("kind"), "end", "base")
    found = both.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,g:int,kind:string,end:bigint,base:boolean>>")
    return read.select("row", "doc_id").join(found, "row", "left").select("doc_id", F.coalesce("found", empty).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _n_base(i: int) -> Column:
    """How many spans in ``found`` are of base generator ``i``; it isn't a parameter of the lambda, whose second one is the place in the array."""
    return F.size(F.filter("found", lambda s: s.base & (s.g == i))).cast("long")


def op3_candidate_boosting(spark, sf_dir: str) -> DataFrame:
    """Contract query: base counts and digest, all spans, and how many there are and were added."""
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda s: s.base)
    n = [_n_base(i).alias(f"n_{GENERATORS[i][0]}") for i in range(BASE)]
    return out.select("doc_id", *n, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"), (F.size("found") - F.size(base)).cast("long").alias("n_added"))


def brute_force_added(text: str | None, model: tuple[Trees, list[float]]) -> list[tuple[str, int, int]]:
    """The added spans of one text by the definition, for tests."""
    trees, least = model
    text, picked = text or "", []
    base = [(a, z) for _, a, z in brute_force(text)]
    for g in range(BASE, len(GENERATORS)):
        for found in re.finditer(GENERATORS[g][1], text):
            a, z = found.span()
            if g == VALUE_OF:
                a += re.match(NAMED, found.group()).end()
            m = text[a:z]
            # the sides stop at the generator's own neighbouring matches
            others = [x.span() for x in re.finditer(GENERATORS[g][1], text)]
            lo = max([e for _, e in others if e <= found.start()], default=0)
            hi = min([s for s, _ in others if s >= z], default=len(text))
            part = {"left": text[lo:a][-SIDE:], "m": m, "right": text[z:hi][:SIDE]}
            x = [g, len(m), *(len(re.findall(p, m)) for p in COUNTS.values()), *(float(bool(re.search(p, part[s]))) for s, p in LOOKS.values())]
            margin = float(trees.margin(np.array([x], float))[0])
            if margin >= least[g] and not any(s < z and a < e for s, e in base):
                picked.append((a, z, margin, g))
    out: list[list] = []
    for a, z, margin, g in sorted(picked, key=lambda s: (s[0], s[3], s[1])):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
            out[-1][2] = max(out[-1][2], (margin, -g))
        else:
            out.append([a, z, (margin, -g)])
    return [(GENERATORS[-k][0], a, z) for a, z, (_, k) in out]


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans of one text by the contract's words, for tests."""
    import re

    def card(m):
        ds = [int(c) for c in m if c.isdigit()]
        return 12 <= len(ds) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(ds))) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", card),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
    ]
    out = []
    for k, (kind, pattern, good) in enumerate(rules):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "") if good(m.group())]
    return [(kind, a, z) for a, _, kind, z in sorted(out)]
