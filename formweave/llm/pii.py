"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent. DataFrame functions only.

Detected entities (e-mail addresses, IBANs, card and phone numbers, social security numbers, IPv4 addresses, and names)
are replaced in the text. An entity's norm (digits only, lower case, ...) is hashed with a secret key of the caller, so
that the same entity gets the same surrogate in every document and format:

* digits of a number stay as many, and fall into the places of the original's format; card numbers keep their first
  digit and pass the Luhn check if the original does; IBANs keep their country and pass the modulo-97 check if the
  original does; phone numbers keep a country code and the line prefix 555;
* e-mail local parts and domains are replaced apart, so that people of one domain share one; IPv4 octets stay octets;
* names are found behind titles. The words of a document's titled names are its name words, and each of them is
  replaced wherever it stands in that document as a word with a capital, with this, another or no title: whoever is
  named with a title once is nowhere left in clear, and shares the surrogate. The last word of a name is a family
  name; the words before it are given names, whose gender is that of the first titled name with them that tells one.
  A word that is the last of a longer name is a family name throughout the document. Surrogates keep the role, the
  gender, the script (Latin, Cyrillic or Greek) and capitals. Later attempts are longer, so that names cannot run out.

Collision check: all different entities are given a surrogate; where two share one, or where a surrogate is itself an
entity of the corpus, all but the first are tried again with the next attempt number, round after round until all
differ. From half the attempts on, which only formats with few free places reach, a surrogate may be another entity of
the corpus, though never the entity itself. Phone and social security numbers left after ``ATTEMPTS`` are matched with
the free places of their formats by rank in the order of keyed hashes, those that are no entities first; the few that
would get themselves pass their places round, so that full formats are permuted. All other kinds have far more places
than a corpus has entities, and go on until all differ.

Texts are searched once: the text between entities and the entities are kept in a table, from which the different
entities, the few exceptions of each row and the new texts are taken without a shuffle of texts.

Defined results: a null text stays null with no entities; repeated rows get equal results; null ``doc_id`` values pass
through; words of a name that follow each other count as one entity; an empty table gives an empty table; of clashing
names, ``n_entities`` and the new text replace the input's.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formweave.llm.shared import SMALL_ROWS, checkpointed, others

ATTEMPTS = 40
#: Kinds whose formats can be full.
RANKED = ("phone", "ssn")

#: Fixed patterns, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]{0,63})@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,7}\.[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "ip": r"(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![A-Za-z0-9]|\.[0-9])",
    "phone": r"(?<![A-Za-z0-9])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![A-Za-z0-9])",
}
_EMAIL, _NUMBERS = PATTERNS["email"], "|".join(f"(?:{p})" for kind, p in PATTERNS.items() if kind != "email")
#: Titles, and what a name word is.
TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Mme|Mlle|Herr|Frau|Señor|Señora|Sr|Sra|Г-н|Г-жа|Κος|Κα)"
WORD = r"\p{Lu}\p{L}{0,40}+(?:['-](?![sS](?!\p{L}))\p{L}{1,40}+){0,4}(?!\p{L})"
NAME = rf"(?=[MDPHFSГΚ])(?<!\p{{L}}){TITLE}\.? {WORD}(?: {WORD}){{0,2}}"
_CAPITAL = rf"(?<!\p{{L}}){WORD}"
#: Titles that tell a gender.
FEMALE = r"^(?:Mrs|Ms|Miss|Mme|Mlle|Frau|Señora|Sra|Г-жа|Κα)[. ]"
MALE = r"^(?:Mr|Herr|Señor|Sr|Г-н|Κος)[. ]"
#: Endings of given names by script and gender, and syllables of which names are made.
ENDINGS = {
    "latin": {"f": ["na", "lia", "ra", "la", "ria", "sa", "nia", "ta"], "m": ["n", "r", "s", "ron", "tin", "vid", "mir", "ton"]},
    "cyrillic": {"f": ["на", "ва", "ла", "ра", "ня", "да", "та", "са"], "m": ["н", "р", "с", "в", "лав", "мир", "тон", "рис"]},
    "greek": {"f": ["να", "λη", "ρα", "σω", "νη", "λια", "ρω", "τα"], "m": ["νος", "λης", "ρος", "σος", "ντης", "μος", "τος", "κης"]},
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so".split(),
    "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со".split(),
    "greek": "βα βε βι βο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο".split(),
}


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern the whole entity is, or null."""
    return reduce(lambda acc, x: acc.when(entity.rlike(rf"\A(?:{x[1]})\z"), x[0]), PATTERNS.items(), F.when(F.lit(False), ""))


def norm_of(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return F.when(kind.isin("card", "phone", "ssn"), digits).when(kind == "iban", F.regexp_replace(entity, " ", "")).otherwise(F.lower(entity))


def _hash(key: str, what: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), attempt.cast("string"), what), 256)


def _number(hexes: Column, at: int, width: int = 7) -> Column:
    return F.conv(F.substring(hexes, at, width), 16, 10).cast("long")


def _digits(hexes: Column) -> Column:
    """64 digits from a hash: nearly even, a-f standing for 0-5."""
    return F.translate(hexes, "abcdef", "012345")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x) % 10


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals, A standing for 10."""
    each = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(each, F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97)


def _checked_iban(norm: Column, country: Column, body: Column) -> Column:
    """Country, check digits and body: the first two digits of ``body`` stay where ``norm`` fails the check."""
    account = F.substring(body, F.lit(3), F.length(body))
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 4))) == 1
    return F.concat(country, F.when(valid, check).otherwise(F.substring(body, 1, 2)), account)


def surrogate_norm(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The norm of an entity's surrogate at an attempt."""
    h = _hash(key, F.concat_ws(":", kind, norm), attempt)
    stream, n = _digits(h), F.length(norm)
    body = F.concat(F.substring(norm, 1, 1), F.substring(stream, F.lit(1), n - 2))
    check = F.when(_luhn(norm) == 0, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")).otherwise(F.substring(stream, 64, 1))
    card = F.concat(body, check)
    cut = n - 10  # digits before the area code, where there are that many
    us = (n >= 10) & (F.substring(norm, -7, 3) == "555")
    phone = F.when(us, F.concat(F.substring(norm, F.lit(1), cut), F.substring(stream, 1, 3), F.lit("555"), F.substring(stream, 4, 4))).otherwise(F.concat(F.substring(norm, F.lit(1), F.least(n, F.lit(2))), F.substring(stream, F.lit(1), F.greatest(n - 2, F.lit(0)))))
    ssn = F.substring(stream, F.lit(1), n)
    iban = _checked_iban(norm, F.substring(norm, 1, 2), F.array_join(F.transform(F.filter(F.split(F.substring(norm, F.lit(3), n), ""), lambda c: c != ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(stream, i + 1, F.lit(1))).otherwise(F.chr(F.lit(65) + F.conv(F.substring(h, i + 1, F.lit(1)), 16, 10).cast("int")))), ""))
    domain_hash = _hash(key, F.concat(F.lit("domain:"), F.substring_index(norm, "@", -1)), F.lit(0))
    letters = F.translate(F.substring(h, 1, 10), "0123456789", "ghijklmnop")
    email = F.concat(letters, F.lit("@"), F.translate(F.substring(domain_hash, 1, 8), "0123456789", "qrstuvwxyz"), F.lit(".example.org"))
    ip = F.concat_ws(".", *((_number(h, 1 + 7 * i) % 254 + 1).cast("string") for i in range(4)))
    bare, gender = F.substring_index(norm, ":", -1), F.substring_index(norm, ":", 1)
    more = _hash(key, F.concat(F.lit("longer:"), norm), attempt)

    def syllables(script: str, n: int) -> Column:
        longer = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 8).cast("int")), lambda i: _pick(SYLLABLES[script], F.conv(F.substring(more, i * 7 + 1, F.lit(7)), 16, 10).cast("long"))), "")
        return F.concat(*(_pick(SYLLABLES[script], _number(h, 15 + 7 * i)) for i in range(n)), F.when(attempt > 0, longer).otherwise(""))

    def given(script: str) -> Column:
        female = (gender == "f") | ((gender == "") & (_number(h, 1) % 2 == 0))
        return F.concat(syllables(script, 2), F.when(female, _pick(ENDINGS[script]["f"], _number(h, 8))).otherwise(_pick(ENDINGS[script]["m"], _number(h, 8))))

    def named(made: Callable[[str], Column]) -> Column:
        return F.when(bare.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(bare.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))

    name = F.when(kind == "given", F.concat(gender, F.lit(":"), named(given))).otherwise(named(lambda script: syllables(script, 4)))
    return F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "email", email).when(kind == "ip", ip).otherwise(name)


def _woven(entity: Column, symbol: str, norm: Column) -> Column:
    """The norm's characters in the places that ``symbol`` matches in the entity."""
    between, own = F.split(entity, symbol, -1), F.filter(F.split(norm, ""), lambda c: c != "")
    return F.array_join(F.zip_with(between, own, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def shown(kind: Column, entity: Column, norm: Column) -> Column:
    """A surrogate's norm in the format of the entity it stands for."""
    bare = F.substring_index(norm, ":", -1)
    cased = F.when((entity == F.upper(entity)) & (F.length(entity) > 1), F.upper(bare)).otherwise(F.initcap(bare))
    return F.when(kind.isin("card", "phone", "ssn"), _woven(entity, "[0-9]", norm)).when(kind == "iban", _woven(entity, "[A-Z0-9]", norm)).when(kind.isin("family", "given"), cased).otherwise(norm)


def _named(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the lower-case name words of each document: ``__last`` and ``__first`` with genders."""
    titled = F.when(text.rlike(NAME), F.regexp_extract_all(text, F.lit(NAME), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gender = lambda e: F.when(e.rlike(FEMALE), "f").when(e.rlike(MALE), "m").otherwise("")
    words = lambda e: F.split(F.lower(F.regexp_replace(e, rf"^{TITLE}\.? ", "")), " ")
    rows = docs.withColumn("__titled", F.transform(titled, lambda e: F.struct(gender(e).alias("gender"), words(e).alias("words"))))
    first = F.transform("__titled", lambda t: F.transform(F.slice(t["words"], F.lit(1), F.size(t["words"]) - 1), lambda w: F.struct(w.alias("word"), t["gender"].alias("gender"))))
    rows = rows.withColumn("__first", F.array_sort(F.array_distinct(F.flatten(first)), lambda a, b: F.when(a["gender"] > b["gender"], -1).when(a["gender"] < b["gender"], 1).otherwise(0)))
    rows = rows.withColumn("__given", F.transform("__first", lambda x: x["word"]))
    long_last = F.array_distinct(F.transform(F.filter("__titled", lambda t: F.size(t["words"]) > 1), lambda t: F.element_at(t["words"], -1)))
    every_last = F.array_distinct(F.transform("__titled", lambda t: F.element_at(t["words"], -1)))
    return rows.withColumn("__last", F.array_union(long_last, F.array_except(every_last, F.col("__given")))).drop("__titled")


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__parts`` (the text between entities) and ``__found`` (entity, kind, norm; kind null: no entity)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = _named(docs, whole)
    has = {"": F.size("__last") > 0, _EMAIL: F.contains(whole, F.lit("@")), _NUMBERS: whole.rlike("[0-9][^A-Za-z]{0,3}[0-9]")}
    pattern = F.array_join(F.array_compact(F.array(F.when(has[_EMAIL], _EMAIL), F.when(has[_NUMBERS], _NUMBERS), F.when(has[""], _CAPITAL))), "|")
    some = has[""] | has[_EMAIL] | has[_NUMBERS]
    rows = rows.withColumn("__pattern", F.when(some, pattern).otherwise("(?!)"))
    rows = rows.withColumn("__hit", F.when(some, F.regexp_extract_all(whole, F.col("__pattern"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("__parts", F.when(F.size("__hit") > 0, F.split(whole, F.col("__pattern"), -1)))

    def entity(e: Column) -> Column:
        low = F.lower(e)
        name = F.when(F.array_contains("__last", low), "family").when(F.array_contains("__given", low), "given")
        kind = F.when(e.rlike(rf"\A{WORD}\z"), name).otherwise(kind_of(e))
        return F.struct(e.alias("entity"), kind.alias("kind"))

    def normed(x: Column) -> Column:
        low = F.lower(x["entity"])
        gender = F.element_at(F.filter("__first", lambda g: g["word"] == low), 1)["gender"]
        norm = F.when(x["kind"] == "given", F.concat(gender, F.lit(":"), low)).when(x["kind"].isNotNull(), norm_of(x["kind"], x["entity"]))
        return F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), norm.alias("norm"))

    rows = rows.withColumn("__found", F.transform("__hit", entity))
    return rows.withColumn("__found", F.transform("__found", normed)).drop("__hit", "__pattern", "__first", "__given", "__last")


def exceptions(entities: DataFrame, key: str) -> DataFrame:
    """``kind, norm, surrogate`` of the entities whose first surrogate is not theirs alone.

    ``entities`` has the different kinds and norms of the corpus, checkpointed.
    """

    def tried(rows: DataFrame, attempt: int) -> DataFrame:
        return rows.select("kind", "norm", surrogate_norm(F.col("kind"), F.col("norm"), F.lit(attempt), key).alias("surrogate"))

    originals = entities.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("real"))
    first = checkpointed(tried(entities, 0))
    settled, left, done = first, first, first.limit(0)
    for attempt in count(1):
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("norm"))
        judged = left.withColumn("place", place).join(originals, ["kind", "surrogate"], "left")
        if attempt > 1:  # also apart from what others have got already
            judged = judged.join(settled.select("kind", "surrogate", F.lit(True).alias("used")), ["kind", "surrogate"], "left")
        else:
            judged = judged.withColumn("used", F.lit(None).cast("boolean"))
        apart = F.col("real").isNull() | (F.lit(attempt > ATTEMPTS // 2) & (F.col("surrogate") != F.col("norm")))
        judged = checkpointed(judged.withColumn("own", (F.col("place") == 1) & apart & F.col("used").isNull()))
        good = judged.where("own").select("kind", "norm", "surrogate")
        if attempt == 1:
            settled = good
        else:
            settled, done = settled.unionByName(good), done.unionByName(good)
        bad = judged.where(~F.col("own")).select("kind", "norm")
        if attempt == ATTEMPTS:
            ranked = by_rank(bad.where(F.col("kind").isin(*RANKED)), settled, originals, key)
            settled, done = (x.join(ranked.select("kind", "norm"), ["kind", "norm"], "left_anti").unionByName(ranked) for x in (settled, done))
            bad = bad.where(~F.col("kind").isin(*RANKED))
        if not bad.limit(1).count():
            return done
        left = checkpointed(tried(bad, attempt))


def by_rank(left: DataFrame, settled: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """``kind, norm, surrogate`` of all rows of ``left`` and of the settled rows that change places with them."""
    keyed = lambda c: F.sha2(F.concat_ws("|", F.lit(key), F.lit("rank"), "kind", c), 256)
    form = ["kind", "head", "n", "us"]

    def formed(rows: DataFrame) -> DataFrame:
        n = F.length("norm")
        us = (F.col("kind") == "phone") & (n >= 10) & (F.substring("norm", -7, 3) == "555")
        head = F.when(us, F.substring("norm", F.lit(1), n - 10)).when(F.col("kind") == "phone", F.substring("norm", 1, 2)).otherwise("")
        return rows.withColumn("n", n).withColumn("us", us).withColumn("head", head)

    left = checkpointed(formed(left))
    used = settled.groupBy("kind", F.length("surrogate").alias("n")).agg(F.count("*").alias("n_used"))
    formats = left.groupBy(*form).agg(F.count("*").alias("n_left")).join(used, ["kind", "n"], "left")
    digits = F.when(F.col("us"), 7).otherwise(F.col("n") - F.length("head"))
    formats = formats.withColumn("digits", digits).withColumn("all", F.pow(F.lit(10.0), F.least("digits", F.lit(15))).cast("long"))
    # so many places have enough free ones among them
    formats = formats.withColumn("some", F.least("all", F.coalesce("n_used", F.lit(0)) + 2 * F.col("n_left") + 2)).withColumn("start", _number(keyed(F.concat_ws(":", "head", "n", "us")), 1))
    blocks = formats.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("some") - 1) / 1000))))
    places = blocks.withColumn("i", F.explode(F.sequence(F.col("block") * 1000, F.least(F.col("block") * 1000 + 999, F.col("some") - 1))))
    shown = F.lpad(((F.col("start") + F.col("i")) % F.col("all")).cast("string"), F.col("digits"), F.lit("0"))
    whole = F.when(F.col("us"), F.concat("head", F.substring(shown, 1, 3), F.lit("555"), F.substring(shown, 4, 4))).otherwise(F.concat("head", shown))
    free = places.select(*form, whole.alias("surrogate")).join(settled, ["kind", "surrogate"], "left_anti").join(originals, ["kind", "surrogate"], "left")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*form).orderBy(*by))
    free = free.withColumn("rank", rank(F.col("real").isNotNull(), keyed("surrogate"))).select(*form, "rank", "surrogate")
    matched = checkpointed(left.withColumn("rank", rank(keyed("norm"), "norm")).join(free, [*form, "rank"]).select(*form, "norm", "surrogate"))
    still = matched.where(F.col("norm") == F.col("surrogate"))
    alone = still.groupBy(*form).agg(F.count("*").alias("n_still")).where("n_still = 1").drop("n_still")
    others_of = matched.where(F.col("norm") != F.col("surrogate")).unionByName(formed(settled).select(*matched.columns))
    one = F.min(F.struct(keyed("norm").alias("by"), "norm", "surrogate")).alias("one")
    partners = others_of.join(alone, form, "left_semi").groupBy(*form).agg(one).select(*form, "one.norm", "one.surrogate")
    ring, turn = Window.partitionBy(*form), Window.partitionBy(*form).orderBy("norm")
    passed = F.coalesce(F.lead("surrogate").over(turn), F.first("surrogate").over(ring.orderBy("norm")))
    moved = checkpointed(still.unionByName(partners).withColumn("surrogate", passed).select("kind", "norm", "surrogate"))
    return checkpointed(matched.select("kind", "norm", "surrogate").join(moved, ["kind", "norm"], "left_anti").unionByName(moved))


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and ``n_entities``; ``key`` is the caller's secret."""
    keep = others(docs, "n_entities")
    found = detect(docs.select(*keep), text).withColumn("__row", F.monotonically_increasing_id())
    bare = F.when(F.size("__found") == 0, F.col(text))  # else it is in the parts
    rows = checkpointed(found.withColumn(text, bare))
    held = rows.where(F.size("__found") > 0).select("__row", F.explode("__found").alias("x")).where("x.kind is not null").select("__row", "x.kind", "x.norm")
    odd = checkpointed(exceptions(checkpointed(held.select("kind", "norm").distinct()), key))
    n_odd = odd.count()
    if n_odd:
        side = F.broadcast(odd) if n_odd <= SMALL_ROWS else odd
        fixes = held.distinct().join(side, ["kind", "norm"])
        fixes = checkpointed(fixes.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "norm"), F.col("surrogate")))).alias("__fix")))
        rows = rows.join(F.broadcast(fixes) if fixes.count() <= SMALL_ROWS else fixes, "__row", "left")
    else:
        rows = rows.withColumn("__fix", F.lit(None).cast("map<string,string>"))

    def put(x: Column) -> Column:
        fixed = F.element_at(F.col("__fix"), F.concat_ws(":", x["kind"], x["norm"]))
        return F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), F.coalesce(fixed, surrogate_norm(x["kind"], x["norm"], F.lit(0), key)).alias("norm"))

    rows = rows.withColumn("__new", F.transform("__found", lambda x: F.when(x["kind"].isNotNull(), put(x))))
    rows = rows.withColumn("__new", F.zip_with("__new", "__found", lambda n, x: F.when(n.isNull(), x["entity"]).otherwise(shown(n["kind"], n["entity"], n["norm"]))))
    whole = F.array_join(F.zip_with("__parts", "__new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    new = F.when(F.size("__found") > 0, whole).otherwise(F.col(text))
    name = lambda x: F.coalesce(x["kind"].isin("family", "given"), F.lit(False))
    goes_on = lambda i: (i > 0) & name(F.get("__found", i - 1)) & (F.get("__parts", i) == " ")
    first = F.filter("__found", lambda x, i: x["kind"].isNotNull() & ~(name(x) & F.coalesce(goes_on(i), F.lit(False))))
    return rows.select(*(new.alias(c) if c == text else F.col(c) for c in keep), F.size(first).cast("long").alias("n_entities"))
