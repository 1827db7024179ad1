r"""Surrogates for personal data, all in DataFrame operations.

Entities are found by one pattern: e-mail addresses, labelled or prefixed secrets, account and card
numbers, telephone numbers, IPv4 addresses, and person names after a title or a known given name.  Every
distinct entity (in canonical form: case, spacing and separators removed) gets one keyed surrogate of its
type, so it is replaced alike in all texts and all spellings:

* numbers keep their length, card numbers their first digit and, where they had it, a valid check digit,
  telephone numbers their country code; the spelling's separators stay;
* secrets keep their prefix and the class of each character; addresses stay valid addresses;
* given names are permuted within their gender and script; surnames keep script, capitals and, in
  Cyrillic, the ending's gender.

Surrogates are drawn from sha2 of key, type, entity and attempt.  A surrogate that two entities share, or
that is itself an entity of the corpus, is drawn again for all but the first, until there is none: so
distinct entities stay distinct.  From the ``LONGER``-th attempt on a surrogate grows by one keyed character
an attempt, so the drawing ends where a short or digit-poor value leaves too few others.  Given names
cannot collide, being permuted.  A number written with its country code and the same one without it are
two entities: which code the short form has is not known.

Texts are searched once; the matches and the pieces between them are kept with the rows.  Occurrences travel as (text key, place, spelling), distinct per text,
so copies of a text cost one; joins are by spelling and by text key, hot ones being ordinary skewed joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, without

KEY = "surrogate-key"
LONGER = 4
# Common given names by gender and script; any list will do.
GIVEN = {
    ("f", "latin"): ["Alice", "Anna", "Barbara", "Carmen", "Charlotte", "Claire", "Elena", "Elizabeth", "Emma", "Ingrid", "Isabel", "Jennifer", "Julia", "Laura", "Linda", "Lucie", "Maria", "Marie", "Mary", "Nora", "Patricia", "Sarah", "Sofia", "Susan"],
    ("m", "latin"): ["Antoine", "Carlos", "Charles", "Daniel", "David", "Fritz", "George", "Hans", "James", "Javier", "John", "Jürgen", "Karl", "Louis", "Michael", "Miguel", "Patrick", "Pedro", "Pierre", "Richard", "Robert", "Thomas", "William", "Wolfgang"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("m", "cyrillic"): ["Александр", "Алексей", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей", "Юрий"],
}
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Monsieur", "Señor", "Señora", "Sr", "Sra"]
LATIN = ["ba", "be", "bor", "da", "del", "fa", "gar", "ha", "kel", "la", "len", "mar", "mo", "na", "ro", "ven"]
CYRILLIC = ["ба", "бе", "бор", "ва", "гор", "да", "зал", "ка", "лу", "мар", "ни", "ро", "са", "то", "ур", "хо"]

_NAMES = [n for names in GIVEN.values() for n in names]
_PREFIXED = r"(?i:AKIA|ASIA)[A-Za-z0-9]{16}\b|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}"     # secrets that need no digit or mark
_SURNAME = r"\p{Lu}[\p{Ll}'’]+(?:-\p{Lu}\p{Ll}+)?"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",      # possessive: a plain group repeats by recursion
    "secret": r"(?<![A-Za-z0-9])(?=[aAgGpPsStT])(?:(?i:(?:api[_-]?key|secret|token|password|passwd|pwd)\b\s*[=:]\s*[\"']?)(?=[+/_-]*+[A-Za-z0-9])[A-Za-z0-9+/_-]{8,}|" + _PREFIXED + ")",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d)])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.? (?:(?:{'|'.join(_NAMES)}) )?{_SURNAME}|(?:{'|'.join(_NAMES)})(?: {_SURNAME})?)(?!\p{{L}})",
}
# most places cannot begin a match: one guard before all patterns
PATTERN = r"(?:(?<![A-Za-z0-9])|(?=[0-9+(]))(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
_BARE_SECRET = rf"(?<![A-Za-z0-9])(?=[aAgs])(?:{_PREFIXED})"
_SECRET_HEAD = r"^((?i:api[_-]?key|secret|token|password|passwd|pwd)\s*[=:]\s*[\"']?|(?i:AKIA|ASIA)|gh[pousr]_|sk-)"


def has_entity(text: Column) -> Column:
    """A match in the text; texts without digits and marks are only searched for names and prefixed secrets."""
    marked = None
    for c in "0123456789@=:":
        marked = text.contains(c) if marked is None else marked | text.contains(c)
    return F.coalesce(F.when(marked, text.rlike(PATTERN)).otherwise(text.rlike(_BARE_SECRET) | text.rlike(PATTERNS["name"])), F.lit(False))


def _kind(raw: Column) -> Column:
    """Type of a match: the first whole pattern it fits."""
    out = None
    for kind, p in PATTERNS.items():
        fits = raw.rlike(f"^(?:{p})$")
        out = F.when(fits, F.lit(kind)) if out is None else out.when(fits, F.lit(kind))
    return out.otherwise(F.lit("name"))


def _parts(raw: Column, kind: Column) -> Column:
    """Entities in a match as (type, canonical form, spelling): one, or the given name and surname of a name."""
    one = lambda t, canon, spelling: F.array(F.struct(t.alias("kind"), canon.alias("canon"), spelling.alias("spelling")))
    digits = F.regexp_replace(raw, r"\D", "")
    value = F.regexp_replace(raw, _SECRET_HEAD, "")
    words = F.filter(F.split(raw, " "), lambda w: ~F.regexp_replace(w, r"\.$", "").isin(TITLES))
    named = F.transform(words, lambda w: F.struct(F.when(w.isin(_NAMES), "given").otherwise("surname").alias("kind"), w.alias("canon"), w.alias("spelling")))
    return (F.when(kind == "name", named).when(kind == "secret", one(kind, value, value)).when(kind == "email", one(kind, F.lower(raw), raw))
            .when(kind == "ip", one(kind, raw, raw)).when(kind == "iban", one(kind, F.replace(raw, F.lit(" ")), raw)).otherwise(one(kind, digits, raw)))


def _seed(kind: Column, canon: Column, attempt: Column) -> Column:
    """64 hexadecimal digits from key, type, entity and attempt; all draws of a surrogate come from it."""
    return F.sha2(F.concat_ws("|", F.lit(KEY), kind, canon, attempt.cast("string")), 256)


def _noise(seed: Column, stream: Column | int = 0) -> Column:
    stream = stream if isinstance(stream, Column) else F.lit(stream)
    return F.sha2(F.concat_ws("|", seed, stream.cast("string")), 256)


def _letters(value: Column, seed: Column) -> Column:
    """Every digit and letter replaced within its class (hexadecimal values stay hexadecimal); other characters stay."""
    alphabet = {"[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    def one(c: Column, i: Column, known: Column) -> Column:
        pick = F.conv(F.substring(_noise(known["seed"], F.floor(i / 8)), F.lit(1).cast("int") + (i % 8).cast("int") * 8, F.lit(8)), 16, 10).cast("long")
        out = None
        for cls, chars in alphabet.items():
            n = F.when(known["hexed"] & F.lit(cls != "[0-9]"), 6).otherwise(len(chars))
            new = F.substring(F.lit(chars), (pick % n + 1).cast("int"), F.lit(1))
            out = F.when(c.rlike(cls), new) if out is None else out.when(c.rlike(cls), new)
        return out.otherwise(c)

    # what holds for the whole value is found once, as the element of an outer array, not once a character
    known = F.struct(seed.alias("seed"), value.rlike("^[0-9a-fA-F]+$").alias("hexed"))
    walked = F.transform(F.array(known), lambda k: F.array_join(F.transform(F.split(value, ""), lambda c, i: one(c, i, k)), ""))
    return F.element_at(walked, 1)


def _surrogate(kind: Column, canon: Column, attempt: Column, seed: Column) -> Column:
    """The keyed surrogate of a canonical entity; ``seed`` is its ``_seed``."""
    d = F.translate(F.concat(_noise(seed), _noise(seed, 1)), "abcdef", "283746")
    more = F.substring(d, F.lit(65), F.greatest(attempt - (LONGER - 1), F.lit(0)))
    size = F.length(canon)
    plain = F.substring(d, F.lit(1), size)
    body = F.concat(F.substring(canon, 1, 1), F.substring(d, F.lit(1), size - 2))
    check = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: F.concat(body, x.cast("string"))), lambda x: F.call_function("luhn_check", x)), 1)
    card = F.when(F.call_function("luhn_check", canon), check).otherwise(F.concat(F.substring(canon, 1, 1), F.substring(d, F.lit(1), size - 1)))
    area = lambda at: F.concat((F.substring(d, at, 1).cast("int") % 8 + 2).cast("string"), F.substring(d, at + 1, 2))
    phone = F.concat(F.substring(canon, F.lit(1), size - 10), area(1), area(4), F.substring(d, 7, 4))
    octet = lambda at, lo, n: (F.substring(d, at, 6).cast("long") % n + lo).cast("string")
    ip = F.concat_ws(".", octet(1, 11, 116), octet(7, 1, 254), octet(13, 1, 254), octet(19, 1, 254))
    hexes = _noise(seed)
    local = F.regexp_extract(canon, "^[^@]*", 0)
    padded = F.concat(local, F.repeat(F.lit("a"), F.greatest(F.lit(0), 8 - F.length(local))))
    tld = F.regexp_extract(canon, r"[^.]*$", 0)
    email = F.concat(_letters(padded, seed), more, F.lit("@mail"), (F.substring(d, 40, 3).cast("int") % 100).cast("string"), F.lit(".example."), F.when(tld.isin("com", "net", "org"), tld).otherwise("org"))
    syllable = lambda table, at: F.element_at(F.array(*[F.lit(s) for s in table]), (F.conv(F.substring(hexes, at, 1), 16, 10).cast("int") + 1))
    stem = lambda table: F.concat(syllable(table, 1), syllable(table, 2), syllable(table, 3), syllable(table, 4), F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(attempt - LONGER, F.lit(0))), lambda k: F.when(k > 0, F.element_at(F.array(*[F.lit(s) for s in table]), (F.conv(F.substring(hexes, k % 56 + 5, F.lit(1)), 16, 10).cast("int") + 1))).otherwise("")), ""))
    cyrillic = F.concat(stem(CYRILLIC), F.when(canon.rlike("[ая]$"), "ова").otherwise("ов"))
    surname = F.initcap(F.when(canon.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(stem(LATIN)))
    iban = F.concat(F.substring(canon, 1, 2), _letters(F.substring(canon, F.lit(3), size), seed))
    return (F.when(kind == "email", email).when(kind == "card", F.concat(card, more)).when((kind == "phone") & (size >= 10), F.concat(phone, more)).when(kind == "ip", ip)
            .when(kind == "secret", F.concat(_letters(canon, seed), more)).when(kind == "iban", F.concat(iban, more)).when(kind == "surname", surname).when(kind == "given", _given(canon))
            .otherwise(F.concat(plain, more)))


def _given(canon: Column) -> Column:
    """Given names go round their gender and script in an order drawn from the key: a permutation without a fixed name."""
    import hashlib
    pairs = []
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{KEY}|{n}".encode()).digest())
        pairs += [(a, b) for a, b in zip(order, order[1:] + order[:1])]
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), canon)


def _render(kind: Column, spelling: Column, surrogate: Column) -> Column:
    """The surrogate with the spelling's separators; what it has beyond the spelling follows at the end."""
    numeric = kind.isin("card", "ssn", "phone", "iban")
    walk = F.aggregate(F.split(spelling, ""), F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
                       lambda acc, c: F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(acc["text"], F.substring(surrogate, acc["at"], F.lit(1))).alias("text"), (acc["at"] + 1).alias("at")))
                       .otherwise(F.struct(F.concat(acc["text"], c).alias("text"), acc["at"].alias("at"))), lambda acc: F.concat(acc["text"], F.substring(surrogate, acc["at"], F.length(surrogate))))
    return F.when(numeric, walk).otherwise(surrogate)


def surrogates(entities: DataFrame, scratch: Scratch) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon): no two entities of a kind share one, and none is itself an entity of the kind."""
    def drawn(d: DataFrame) -> DataFrame:
        return d.withColumn("seed", _seed(F.col("kind"), F.col("canon"), F.col("attempt"))).withColumn("surrogate", _surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), F.col("seed"))).drop("seed")

    now = scratch.keep(drawn(entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0))), "entities")
    taken = now.select("kind", F.lower("canon").alias("surrogate_key")).distinct()
    taken = scratch.keep(taken.withColumn("taken", F.lit(True)), "taken")
    first = Window.partitionBy("kind", "surrogate_key").orderBy("attempt", "canon")
    while True:
        judged = now.withColumn("surrogate_key", F.lower("surrogate")).withColumn("n", F.row_number().over(first)).join(taken, ["kind", "surrogate_key"], "left")
        judged = scratch.keep(judged.withColumn("again", (F.col("kind") != "given") & ((F.col("n") > 1) | F.coalesce("taken", F.lit(False)))), "judged")
        if judged.filter("again").isEmpty():
            return judged.select("kind", "canon", "surrogate")
        kept = judged.filter("not again").select("kind", "canon", "attempt", "surrogate")
        next_ = scratch.keep(kept.unionByName(drawn(judged.filter("again").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))), "entities")
        scratch.drop(now, judged)
        now = next_


def replace_personal_data(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """``docs`` with entities replaced in ``text_col`` and ``n_replaced`` (long) added.

    Null texts stay null (0 replaced), empty ones empty; repeated rows are changed alike; other columns
    stay, one named ``n_replaced`` is replaced.  An empty table gives no rows.
    """
    base = without(docs, "n_replaced")
    text = F.col(text_col)
    match = F.struct(F.sha2(text, 256).alias("tkey"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("found"), F.split(text, PATTERN, -1).alias("pieces"))
    searched = scratch.keep(base.withColumn("_match", F.when(has_entity(text), match)), "searched")
    hits = scratch.keep(searched.filter("_match is not null").select("_match.tkey", "_match.found").groupBy("tkey").agg(F.first("found").alias("found")), "found")
    spelled = hits.select(F.explode("found").alias("raw")).distinct().withColumn("kind", _kind(F.col("raw"))).withColumn("parts", _parts(F.col("raw"), F.col("kind")))
    spelled = scratch.keep(spelled, "spellings")
    parts = spelled.select("raw", F.posexplode("parts").alias("at", "part")).select("raw", "at", "part.*")
    made = surrogates(parts, scratch)
    swaps = parts.join(made, ["kind", "canon"]).select("raw", F.struct("at", "spelling", _render(F.col("kind"), F.col("spelling"), F.col("surrogate")).alias("new")).alias("swap"))
    swaps = swaps.groupBy("raw").agg(F.sort_array(F.collect_list("swap")).alias("swaps"))       # at most the words of one match
    swapped = swaps.select("raw", _swap(F.col("raw"), F.col("swaps")).alias("new"))
    rewritten = hits.select("tkey", F.posexplode("found").alias("at", "raw")).join(scratch.keep(swapped, "swaps"), "raw")
    per_text = scratch.keep(rewritten.groupBy("tkey").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("_news")), "rewrites")   # one text's matches
    changed = searched.filter("_match is not null").withColumn("_tkey", F.col("_match.tkey")).join(per_text.withColumnRenamed("tkey", "_tkey"), "_tkey")
    pieces = F.col("_match.pieces")
    rest = F.slice(pieces, F.lit(2), F.size(pieces))
    joined = F.concat(F.element_at(pieces, 1), F.array_join(F.zip_with("_news", rest, lambda n, p: F.concat(n["new"], p)), ""))
    changed = changed.withColumn("n_replaced", F.size("_news").cast("long")).withColumn(text_col, joined).select(*base.columns, "n_replaced")
    return searched.filter("_match is null").select(*base.columns, F.lit(0).cast("long").alias("n_replaced")).unionByName(changed)


def _swap(raw: Column, swaps: Column) -> Column:
    """Replace the parts' spellings in the match, left to right."""
    def step(acc: Column, s: Column) -> Column:
        at = F.position(s["spelling"], acc["rest"])
        return F.struct(F.concat(acc["done"], F.substring(acc["rest"], F.lit(1), at - 1), s["new"]).alias("done"), F.substring(acc["rest"], at + F.length(s["spelling"]), F.length(acc["rest"])).alias("rest"))

    return F.aggregate(swaps, F.struct(F.lit("").alias("done"), raw.alias("rest")), step, lambda acc: F.concat(acc["done"], acc["rest"]))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_personal_data(docs, Scratch(spark, "op9"))
