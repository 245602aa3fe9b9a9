"""Surrogates for personal data: keyed, type-consistent replacements, in DataFrame functions only.

Entities are found by one pattern a text; equal entities (after normalising case and separators) get one surrogate in
the whole corpus, different ones never share one: candidates that meet another surrogate or a real entity are drawn
again in rounds over the table of distinct entities. Family names are entities of their own, so that all forms of one
person's name keep one family name and no two families share one. Surrogates keep type, length, separators, letter case,
script and, for names, the gender of the title; country codes, top-level domains and issuer digits stay, Luhn sums and
check digits of account numbers stay valid. Card and account numbers whose check sum is wrong are left alone.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Patterns of the entity types, tried in this order at each place.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_WORD = r"\p{Lu}(?:\p{L}|['’-](?=\p{L}{2}))+"
PARTICLES = "van von der den des de del della di da dos du la le zu zum zur ter ten bin al ван фон де".split()
_PARTICLE = "(?:" + "|".join(f"[{p[0].upper()}{p[0]}]{p[1:]}" for p in PARTICLES) + ") "
_NAME = rf"(?:(?:{_PARTICLE}){{1,3}}{_WORD}|{_WORD}(?: (?:{_PARTICLE}){{0,3}}{_WORD})?)"
#: Academic titles after the form of address stay where they are.
_ACADEMIC = r"(?:(?:Dr|Prof|Ing|Dipl|Mag|med|jur|phil)\.?(?:-\p{L}+\.?)? )"
#: Offices and shows that follow a form of address without being names.
NO_NAMES = "President|Vice|Speaker|Chairman|Chairwoman|Chair|Secretary|Justice|Minister|Ambassador|Mayor|Judge|Universe|World|America|Right|Präsident|Bundeskanzler|Minister|Président|Ministre|Presidente|Ministro|Президент|Министр"
MALE = r"(?:Mr|Herr|Monsieur|Señor|Sr|Господин|господин)"
FEMALE = r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|госпожа)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "cloud_key": r"(?<![A-Z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])",
    # after a colon without a quote prose may follow: a digit, mixed case, a sign within or a letter without case is wanted
    "secret": r"(?<=[=:\"'\s])(?<=(?i:password|passwd|secret|token|api[_-]key|apikey)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?)(?=[^\s\"']*[\p{L}\p{N}])"
              r"(?:(?<=[=\"'][ \t]{0,3})|(?=[^\s\"']*(?:[\p{N}\p{Lo}]|\p{Ll}[^\s\"']*\p{Lu}|[!@#$%^&*~+]\p{L})))[^\s\"']{6,}",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "card": r"(?<![\d.+-])(?:\d{4}[ -]?){3}\d{4}(?![\d-])|(?<![\d.+-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\d-])",
    "ip": rf"(?<![\d.])(?<!(?i:version|release|build|\bv)[ .:]{{0,2}})(?!127\.|0\.0\.0\.0)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
    # a name is matched together with its title so that its gender is known
    "name": rf"(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? {_ACADEMIC}{{0,3}}+(?!(?:{NO_NAMES})(?!\p{{L}})){_NAME}",
}
#: One match of any type.
ANY = "|".join(PATTERNS.values())
#: A text without any of these holds no entity; it is passed on without a search.
GUARD = rf"@|\d[\d ().-]{{5}}|(?:AKIA|ASIA)[0-9A-Z]|(?i:password|passwd|secret|token|api[_-]?key)[\"']?[ \t]*[=:]|(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? \p{{L}}"
#: Plain substrings, one of which every text that GUARD finds has; they cost far less than the pattern.
HINTS = ("@", "=", ":", "AKIA", "ASIA", *"Mr Herr Monsieur Señor Sr Господин господин Ms Miss Frau Madame Mme Госпожа госпожа".split())
# Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carlos David Emil Felix Gabriel Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Robert Simon Thomas Victor",
    ("latin", "f"): "Anna Bella Clara Diana Elena Fiona Greta Helena Irene Julia Karla Laura Maria Nina Olivia Paula Rosa Sara Teresa Vera",
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Лариса Мария Ольга",
    ("greek", "m"): "Αλέξανδρος Γεώργιος Δημήτρης Ηλίας Ιωάννης Κώστας Λεωνίδας Νίκος Πέτρος Στέφανος",
    ("greek", "f"): "Άννα Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα",
    ("armenian", "m"): "Արամ Գագիկ Դավիթ Հակոբ Նարեկ Տիգրան",
    ("armenian", "f"): "Անահիտ Գայանե Լուսինե Մարիամ Նարե Սոնա",
}
SYLLABLES = {"latin": "ba ber den dor el fen gar hol in kas lan mer nor os par ran sel tor ul ven wal wen zan zel".split(), "cyrillic": "ба бер ва ден дор гал кол лан мар нов ор пет ров сел тин".split(),
             "greek": "βα γαρ δελ ζαν θεο καλ λαν μαρ νικ παπ ραλ σαν τορ φιλ χαρ".split(), "armenian": "բա դան գար լեն մար նոր սար տեր վան կար պետ ռոս".split()}
#: How letters of a script other than Latin are known.
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "armenian": r"\p{IsArmenian}"}


def _kind(m: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, p in PATTERNS.items():
        if kind == "secret":
            continue
        out = out.when(m.rlike(f"^(?:{p})$"), kind)
    return out.otherwise("secret")


def _norm(kind: Column, m: Column) -> Column:
    return (F.when(kind == "email", F.lower(m)).when(kind.isin("phone", "card", "ssn"), F.regexp_replace(m, r"\D", ""))
            .when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).otherwise(m))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _stream(key: str, kind: Column, norm: Column, attempt: Column, i: Column) -> Column:
    """A keyed number (HMAC-SHA256) for the i-th character (0 .. 2^32)."""
    block = hashlib.sha256(key.encode()).digest().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    message = F.concat_ws("\u0001", kind, norm, attempt.cast("string"), i.cast("string")).cast("binary")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


ALPHABETS: tuple[tuple[str, str], ...] = (("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\d", "0123456789"), ("[а-я]", "абвгдежзийклмнопрстуфхцчшщэюя"), ("[А-Я]", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ"), ("[α-ω]", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{Ll}", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý"), (r"\p{Lu}", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"),
             (r"\p{IsHan}", "人大小山水火木金土日月天地中上下左右東西南北春秋冬夏花草林石田力子女目耳手足心口"), (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"), (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"),
             (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호"), (r"(?=\p{IsArabic})\p{L}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), (r"(?=\p{IsHebrew})\p{L}", "אבגדהוזחטיכלמנסעפצקרשת"),
             (r"(?=\p{IsThai})\p{L}", "กขคฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ"), (r"(?=\p{IsDevanagari})\p{L}", "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह"),
             ("[٠-٩]", "٠١٢٣٤٥٦٧٨٩"), ("[۰-۹]", "۰۱۲۳۴۵۶۷۸۹"), ("[०-९]", "०१२३४५६७८९"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"), (r"\p{N}", "0123456789"))
#: What lengthens an entity whose own length has no free surrogate left; drawn like the entity's own characters.
FILLERS = {"email": "a" * 16, "secret": "a" * 16, "cloud_key": "A" * 16, "iban": "0" * 12, "card": "0" * 12, "ssn": "0" * 12, "phone": "0" * 12}


def _same_class(c: Column, n: Column, hexes: Column) -> Column:
    """A character of the class of ``c``, and of its script where it is a known one; separators and signs stay."""
    out = F.when(hexes & c.rlike("[a-f]"), F.substring(F.lit("abcdef"), (n % 6 + 1).cast("int"), F.lit(1)))
    for p, letters in ALPHABETS:
        out = out.when(c.rlike(p), F.substring(F.lit(letters), (n % len(letters) + 1).cast("int"), F.lit(1)))
    return out.otherwise(c)


def _luhn_rest(digits: Column) -> Column:
    """Luhn sum of a digit array modulo 10."""
    return F.aggregate(F.reverse(digits), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), lambda acc, d: F.struct(
        (acc["s"] + F.when(acc["i"] % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))).alias("s"), (acc["i"] + 1).alias("i")))["s"] % 10


def _mod97(chars: Column) -> Column:
    """Account number as digits (A = 10 ..), country and check digits last, modulo 97."""
    moved = F.concat(F.slice(chars, 5, F.greatest(F.size(chars) - 4, F.lit(0))), F.slice(chars, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + value(c)).otherwise(acc * 100 + value(c)) % 97)


def _lengthened(kind: Column, norm: Column) -> Column:
    out = norm
    for name, filler in FILLERS.items():
        out = F.when(kind == name, F.concat(F.regexp_extract(norm, "^[^@]*", 0), F.lit(filler), F.regexp_extract(norm, "@.*$", 0)) if name == "email" else F.concat(norm, F.lit(filler))).otherwise(out)
    return out


def _drawn(open_: DataFrame, key: str, attempt: int, longer: bool) -> DataFrame:
    """``open_`` (kind, norm, kept, family) with the candidate ``surrogate`` of each entity. ``kept``: leading characters that
    stay; ``family``: the surrogate of a name's family name. ``longer``: one of more characters than the entity has, out
    of 10^12 values or more; addresses become unique local ones (IPv6). Step by step, so that expressions stay small."""
    kind, norm, no = F.col("kind"), F.col("norm"), F.lit(attempt)
    out = open_.withColumn("_t", _lengthened(kind, norm) if longer else norm).withColumn("_c", _chars(F.col("_t")))
    out = out.withColumn("_n", F.transform("_c", lambda c, i: _stream(key, kind, norm, no, i)))
    tld = F.length("_t") - F.length(F.regexp_extract("_t", r"\.[^.@]*$", 0))
    hexes = (kind == "secret") & F.col("_t").rlike("^[0-9a-f]+$")
    stays = lambda i: (i < F.col("kept")) | ((kind == "email") & (i >= tld))
    out = out.withColumn("_d", F.transform("_c", lambda c, i: F.when(stays(i), c).otherwise(_same_class(c, F.get("_n", i), hexes))))
    rest = F.greatest(F.size("_d") - 1, F.lit(0))
    # a card's check digit goes last; it makes the sum of the whole a multiple of ten again
    out = out.withColumn("_e", F.when((kind == "card") & (_luhn_rest(_chars(norm)) == 0), F.concat(F.slice("_d", 1, rest), F.array(F.lit("0"))))
                         # the two check digits after an account's country leave a rest of one
                         .when((kind == "iban") & (_mod97(_chars(norm)) == 1), F.concat(F.slice("_d", 1, 2), F.array(F.lit("0"), F.lit("0")), F.slice("_d", 5, F.greatest(F.size("_d") - 4, F.lit(0))))))
    card = F.concat(F.array_join(F.slice("_e", 1, rest), ""), ((10 - _luhn_rest(F.col("_e"))) % 10).cast("string"))
    iban = F.concat(F.array_join(F.slice("_e", 1, 2), ""), F.lpad((98 - _mod97(F.col("_e"))).cast("string"), 2, "0"), F.array_join(F.slice("_e", 5, F.greatest(F.size("_e") - 4, F.lit(0))), ""))
    byte = lambda i, n, low=0: (F.get("_n", F.lit(i)) % n + low).cast("string")
    if longer:
        digits = F.concat(F.lit("fd"), *[F.lpad(F.hex(F.get("_n", F.lit(i))), 8, "0") for i in range(4)])
        ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.substring(digits, i * 4 + 1, F.lit(4)))), ":")
    else:
        ip = (F.when(norm.startswith("10."), F.concat_ws(".", F.lit("10"), byte(1, 256), byte(2, 256), byte(3, 256)))
              .when(norm.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), byte(2, 256), byte(3, 256)))
              .otherwise(F.concat_ws(".", byte(0, 112, 11), byte(1, 256), byte(2, 256), byte(3, 256))))
    surrogate = (F.when(kind == "ip", ip).when(F.col("_e").isNotNull(), F.when(kind == "card", card).otherwise(iban)).when(kind == "name", _name(key, norm, F.col("family"), no, longer))
                 .when(kind == "family", F.concat(F.regexp_extract(norm, rf"^(?:{_PARTICLE}){{0,3}}", 0), _syllables(key, "family", norm, norm, no, no + 2))).otherwise(F.array_join("_d", "")))
    return out.select("kind", "norm", "kept", "family", surrogate.alias("surrogate"))


_TITLE = rf"^(?:{MALE}|{FEMALE})\.? {_ACADEMIC}{{0,3}}+"


def _family(norm: Column) -> Column:
    """The last word of a name with a title, with the particles before it."""
    return F.regexp_extract(norm, rf"(?<![^ ])((?:{_PARTICLE}){{0,3}}[^ ]+)$", 1)


def _given(norm: Column) -> Column:
    """Whether a name with a title has a given name."""
    return F.regexp_replace(norm, _TITLE, "") != _family(norm)


def _syllables(key: str, what: str, seed: Column, like: Column, attempt: Column, last: Column) -> Column:
    """A word of drawn syllables in the script of ``like``; the draw depends on ``seed``."""
    out = F.lit("")
    for s, parts in SYLLABLES.items():
        bits = F.array(*[F.lit(x) for x in parts])
        word = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.element_at(bits, (_stream(key, F.lit(what), seed, attempt, i) % len(parts) + 1).cast("int"))), ""))
        out = F.when(like.rlike(SCRIPTS[s]), word).otherwise(out) if s in SCRIPTS else word
    return out


def _name(key: str, norm: Column, family: Column, attempt: Column, longer: bool) -> Column:
    """Title as it was, then a given name of its gender and script where there was one, and the surrogate family name.
    ``longer``: the given names of one family have run out, so one of syllables is drawn."""
    title, rest = F.regexp_extract(norm, _TITLE, 0), F.regexp_replace(norm, _TITLE, "")
    gender, script = F.when(title.rlike(f"^{FEMALE}"), "f").otherwise("m"), F.lit("latin")
    for s, letters in SCRIPTS.items():
        script = F.when(rest.rlike(letters), s).otherwise(script)
    given = F.lit("")
    for (s, g), names in GIVEN.items():
        words = F.array(*[F.lit(x) for x in names.split()])
        given = F.when((script == s) & (gender == g), F.element_at(words, (_stream(key, F.lit("given"), F.concat(gender, rest), attempt, F.lit(0)) % len(names.split()) + 1).cast("int"))).otherwise(given)
    if longer:
        given = _syllables(key, "given", F.concat(gender, rest), rest, attempt, attempt + 3)
    return F.concat(title, F.when(_given(norm), F.concat(given, F.lit(" "))).otherwise(""), family)


def _refill(m: Column, core: Column) -> Column:
    """``core``'s letters and digits in the places and the letter case of those of ``m``; what a longer one has more follows."""
    cores = F.filter(_chars(core), lambda c: c.rlike(r"[\p{L}\p{N}]"))
    out = F.aggregate(_chars(m), F.struct(F.lit("").alias("t"), F.lit(1).alias("i")), lambda acc, c: F.when(
        c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(acc["t"], F.when(c.rlike(r"\p{Lu}"), F.upper(F.get(cores, acc["i"] - 1))).otherwise(F.get(cores, acc["i"] - 1))).alias("t"), (acc["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(acc["t"], c).alias("t"), acc["i"].alias("i"))))
    return F.concat(out["t"], F.array_join(F.slice(cores, out["i"], F.size(cores)), ""))


def _rounds(entities: DataFrame, key: str, most_rounds: int) -> DataFrame:
    """(kind, norm, surrogate) of ``entities`` (kind, norm, kept, family). Each round draws for those that are still open; a
    candidate holds if it is no real entity, no earlier surrogate, and the smallest entity that drew it. After
    ``most_rounds`` the candidates are longer than the entity, where free ones never run out."""
    done, open_ = None, entities
    for attempt in itertools.count():
        drawn = materialize(_drawn(open_, key, attempt, attempt >= most_rounds))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("owner"))
        clear = first.join(entities.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            clear = clear.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        held = clear.select("kind", F.col("owner").alias("norm"), "surrogate")
        done = held if done is None else done.unionByName(held)
        done = materialize(done)
        open_ = drawn.drop("surrogate").join(done.select("kind", "norm"), ["kind", "norm"], "left_anti")
        if open_.isEmpty():
            return done


def surrogates(entities: DataFrame, key: str, most_rounds: int = 12) -> DataFrame:
    """(kind, norm, surrogate) for the distinct entities (kind, norm, kept); no two of a kind share a surrogate."""
    if not key:
        raise ValueError("surrogates need a key")
    names = entities.where("kind = 'name'").select("norm", "kept", _family(F.col("norm")).alias("_f"))
    families = names.select(F.lit("family").alias("kind"), F.col("_f").alias("norm"), F.lit(0).alias("kept"), F.lit(None).cast("string").alias("family")).distinct()
    found = _rounds(families, key, most_rounds).select(F.col("norm").alias("_f"), F.col("surrogate").alias("family"))
    own = names.join(found, "_f").select(F.lit("name").alias("kind"), "norm", "kept", "family")
    every = entities.where("kind <> 'name'").select("kind", "norm", "kept", F.lit(None).cast("string").alias("family")).unionByName(own)
    return _rounds(every, key, most_rounds)


#: Stands around the entities of a text while it is taken apart; no assigned character.
MARK = "\ufdd0"


def _apart(t: Column, pattern: Column) -> Column:
    """text, match, text, match, ... text"""
    marked = F.split(F.regexp_replace(t, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    pairs = F.flatten(F.zip_with(F.split(t, pattern, -1), F.concat(F.regexp_extract_all(t, pattern, F.lit(0)), F.array(F.lit(""))), lambda a, b: F.array(a, b)))
    return F.when(F.contains(t, F.lit(MARK)), F.slice(pairs, 1, F.size(pairs) - 1)).otherwise(marked)


def anonymize(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_entities", most_broadcast: int = 32 << 20) -> DataFrame:
    """``docs`` with surrogates in column ``text`` and, unless ``count`` is None, a last column of that name (int): how many
    entities were found, 0 where none were. An input column named ``count`` gives way to it; all other columns stay.

    Null texts stay null, empty ones empty. Repeated rows are each rewritten alike, whatever their doc_id; whole texts of
    any length are searched. No rows give no rows. A full name that a text gives with a title is also replaced where the same
    text gives it without one, and counted; family names alone are left, as they may be words. Each text is searched once for the table of entities; those that hold
    some are taken apart once more. ``most_broadcast``: bytes of entities that may travel to every executor.
    """
    kept_columns = [c for c in docs.columns if c != count]
    names = [f"_c{i}" for i in range(len(kept_columns))]  # names of our own, so that none can clash
    own = docs.select(*kept_columns).toDF(*names)
    t = F.col(names[kept_columns.index(text)])
    hint = t.rlike("[0-9]")
    for x in HINTS:
        hint = hint | F.contains(t, F.lit(x))
    guarded = F.coalesce(hint & t.rlike(GUARD), F.lit(False))
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    hits = materialize(own.where(guarded).select(F.xxhash64(t).alias("_row"), found.alias("_m")).where("size(_m) > 0").select("_row", F.explode("_m").alias("_m")))
    kind = _kind(F.col("_m"))
    matches = hits.select("_m").distinct().withColumn("kind", kind).withColumn("norm", _norm(F.col("kind"), F.col("_m")))
    kept = (F.when(F.col("kind") == "phone", F.when(F.col("_m").startswith("+"), F.length(F.regexp_extract("_m", r"^\+(\d{1,3})", 1))).otherwise(0))
            .when(F.col("kind") == "cloud_key", 4).when(F.col("kind") == "iban", 2).when(F.col("kind") == "card", 1).otherwise(0))
    # a number without the check sum of its kind is no card or account, just a number
    sound = F.when(F.col("kind") == "card", _luhn_rest(_chars(F.col("norm"))) == 0).when(F.col("kind") == "iban", _mod97(_chars(F.col("norm"))) == 1).otherwise(True)
    matches = materialize(matches.where(sound).withColumn("kept", kept))
    chosen = surrogates(matches.groupBy("kind", "norm").agg(F.max("kept").alias("kept")), key)
    # a longer e-mail address is no refill: its host would move
    whole = F.col("kind").isin("ip", "name") | ((F.col("kind") == "email") & (F.length("surrogate") > F.length("norm")))
    table = matches.join(chosen, ["kind", "norm"]).select("_m", F.when(whole, F.col("surrogate")).otherwise(_refill(F.col("_m"), F.col("surrogate"))).alias("_s"),
                                                               *[F.when((F.col("kind") == "name") & _given(F.col("norm")), F.regexp_replace(c, _TITLE, "")).alias(n) for c, n in (("norm", "_p"), ("surrogate", "_q"))])
    # one row a text that holds entities; the map is no larger than that text
    held = hits.distinct().join(table, "_m")
    rows = held.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_m", "_s"))).alias("_map"), F.sum(F.octet_length("_m") + F.octet_length("_s") + 48).alias("_size"))
    # full names that a text gives with a title are also found without one in that text
    plain = held.where("_p is not null").groupBy("_row", "_p").agg(F.min("_q").alias("_q")).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_p", "_q"))).alias("_plain"), F.sum(F.octet_length("_p") + F.octet_length("_q") + 48).alias("_more"))
    rows = materialize(rows.join(plain, "_row", "left").withColumn("_size", F.col("_size") + F.coalesce("_more", F.lit(0))).drop("_more"))
    size = rows.agg(F.sum(F.col("_size") + 64)).first()[0] or 0
    rows = rows.select("_row", "_map", "_plain")
    if 2 * size <= most_broadcast:  # no text is moved, and none is searched again but those with entities
        joined, others = own.join(F.broadcast(rows), F.xxhash64(t) == F.col("_row"), "left"), None
    else:
        joined = own.where(guarded).join(rows, F.xxhash64(t) == F.col("_row"), "left")
        others = own.where(~guarded).select(*names, F.lit(0).alias("_n"))
    joined = joined.withColumn("_parts", F.when(F.col("_map").isNotNull(), _apart(t, F.lit(ANY))))
    # longer names first, so that none is taken for a shorter one
    bare = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.sort_array(F.map_keys("_plain"), False), "|"), F.lit(r")(?!\p{L}|['’-]\p{L}{2})"))
    joined = joined.withColumn("_bare", bare).withColumn("_parts", F.when(F.col("_plain").isNull(), F.transform("_parts", lambda x: F.array(x))).otherwise(
        F.transform("_parts", lambda x, i: F.when(i % 2 == 1, F.array(x)).otherwise(_apart(x, F.col("_bare"))))))
    swap = lambda part, i: F.transform(part, lambda x, j: F.when(i % 2 == 1, F.coalesce(F.try_element_at("_map", x), x)).when(j % 2 == 1, F.try_element_at("_plain", x)).otherwise(x))
    rebuilt = F.array_join(F.flatten(F.transform("_parts", swap)), "")
    number = F.aggregate(F.transform("_parts", lambda x, i: F.when(i % 2 == 0, (F.size(x) - 1) / 2).otherwise(F.map_contains_key("_map", F.get(x, F.lit(0))).cast("double"))), F.lit(0.0), lambda a, b: a + b)
    out = joined.select(*[(F.when(F.col("_parts").isNull(), t).otherwise(rebuilt).alias(n) if c == text else F.col(n)) for c, n in zip(kept_columns, names)],
                        F.when(F.col("_parts").isNull(), 0).otherwise(number).cast("int").alias("_n"))
    out = out if others is None else others.unionByName(out)
    return out.toDF(*kept_columns, count) if count else out.drop("_n").toDF(*kept_columns)
