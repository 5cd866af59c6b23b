"""Personal data: keyed surrogates, in DataFrame functions only.

Detected entities are replaced by surrogates that follow from a key, the kind and
the entity's canonical form, so every mention of an entity gets the same
surrogate (whatever its case or punctuation) in every document. A surrogate keeps
the kind and the format of its mention: digits stay digits in the same places,
letters keep their case and script, card numbers and IBANs stay valid, parts of IP
addresses keep their length, a given name keeps the gender that its title tells.

A name is known by a title in front of it. Where its text says the whole name again
without a title, that mention gets the same surrogate.

Before texts are changed, the surrogates of all distinct entities of the corpus
are checked: two entities must not share one, and none may equal an entity that
occurs. Those that fail are drawn again until none does; the (few) drawn again
are looked up when texts are changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import replaced, stored

KEY = "change this key"
PATIENCE = 4         # draws after which a surrogate may leave its mention's length
MOST_DRAWS = 64      # more than that is an error: a kind has no surrogates left
INLINE_DRAWS = 500  # up to so many entities drawn again are an inline map; more are joined

# Titles that tell a gender, and the patterns of the kinds.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "г-жа"],
    "n": ["Dr", "Prof"],
}
_TITLE = "|".join(t for own in TITLES.values() for t in sorted(own, key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]"
# Countries that have IBANs.
_IBAN = ("AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|BY|CH|CR|CY|CZ|DE|DK|DO|EE|EG|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IQ|IS|IT|"
         "JO|KW|KZ|LB|LC|LI|LT|LU|LV|LY|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SC|SD|SE|SI|SK|SM|ST|SV|TL|TN|TR|"
         "UA|VA|VG|XK")
PATTERNS = {
    "secret": r"(?<=[\"'])(?<=\b(?i:token|secret|password|passwd|api_key|apikey) {0,3}[=:] {0,3}[\"'])[^\"'\s]{8,}+(?=[\"'])",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": rf"(?=\d)(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    # global, unique local and link-local addresses
    "ipv6": rf"(?=[23Ff])(?<![\w:.])(?=[A-Fa-f:]*\d)(?:[23]{_HEX}{{3}}|[Ff][CDEcde]{_HEX}{{2}})(?:(?::{_HEX}{{1,4}}){{7}}"
            rf"|(?::{_HEX}{{1,4}}){{0,5}}:(?::{_HEX}{{1,4}}){{1,6}})(?![\w:])",
    "ssn": r"(?=\d)(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?=[+(\d])(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\w)"
             r"|(?=\+)(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\w)",
    "card": r"(?=\d)(?<![\w.])(?:\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?!\w)",
    "iban": rf"(?=[A-Z])(?<![A-Za-z0-9])(?:{_IBAN})\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])",
    "name": rf"(?=[DFHMPSГг])(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}+(?:[ \-]\p{{Lu}}\p{{Ll}}+){{0,2}}(?!\p{{L}})",
}
_ANY = "|".join(PATTERNS.values())
# A text without any of these holds no entity; one quick pass. (Every pattern
# and hint begins with a test of one character, so that most places fail at once.)
_HINT = rf"[0-9@]|[=:] {{0,3}}[\"']|(?=[DFHMPSГг])(?:{_TITLE})\.? \p{{Lu}}"

# Characters that may stand for a letter of a script other than ASCII's, and for a
# symbol of a secret without letters and digits (a mask, say).
_SCRIPTS = {"Cyrillic": (0x430, 32), "Greek": (0x3B1, 17), "Han": (0x4E00, 4096), "Hangul": (0xAC00, 4096),
            "Hiragana": (0x3042, 80), "Katakana": (0x30A2, 80), "Arabic": (0x628, 19), "Hebrew": (0x5D0, 27),
            "Devanagari": (0x915, 37), "Thai": (0xE01, 46)}
_SYMBOLS = "!#$%&*+-=?@^_~"

# Syllables of invented names.
_FIRST = {"latin": ["Al", "Be", "Co", "Da", "El", "Fe", "Ga", "Ha", "Jo", "Ka", "Le", "Ma", "Ne", "Or", "Pa", "Ro"],
          "cyrillic": ["Ал", "Бе", "Ва", "Га", "Да", "Жи", "За", "Ка", "Ле", "Ма", "Не", "Ол", "Па", "Ро", "Се", "Та"],
          "greek": ["Αλ", "Βα", "Γε", "Δη", "Ευ", "Ζη", "Θε", "Κα", "Λε", "Μα", "Νι", "Ορ", "Πα", "Ρο", "Στ", "Φι"]}
_MIDDLE = {"latin": ["ba", "ci", "do", "fe", "gu", "ha", "ki", "lo", "mi", "ne", "po", "ri", "sa", "ti", "va", "zo"],
           "cyrillic": ["ба", "ви", "го", "де", "жу", "за", "ки", "ло", "ми", "не", "по", "ри", "са", "ти", "фа", "хо"],
           "greek": ["βα", "γι", "δο", "ζε", "θυ", "κα", "λι", "μο", "νε", "ξα", "πι", "ρο", "σα", "τι", "φα", "χο"]}
_LAST = {"latin": {"given-m": ["n", "rd", "s", "k"], "given-f": ["a", "na", "lla", "ine"],
                   "given-n": ["e", "y", "o", "u"], "family": ["son", "mann", "ford", "berg"]},
         "cyrillic": {"given-m": ["н", "р", "й", "к"], "given-f": ["а", "на", "ла", "ия"],
                      "given-n": ["о", "у", "е", "и"], "family": ["енко", "ук", "ич", "ян"]},
         "greek": {"given-m": ["ος", "ης", "ας", "ων"], "given-f": ["α", "η", "ια", "ω"],
                   "given-n": ["ι", "υ", "ο", "ε"], "family": ["πουλος", "ιδης", "ακης", "ου"]}}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chars(m: Column) -> Column:
    return F.split(m, "")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _luhn_sum(digits: Column, first_weight_two: bool) -> Column:
    """Luhn sum of a digit string; every second digit from the right counts
    twice, beginning with the last one if ``first_weight_two``."""
    d = F.reverse(F.filter(_chars(digits), lambda c: c != ""))
    def weigh(c, i):
        v = c.cast("int")
        twice = (i % 2 == 0) if first_weight_two else (i % 2 == 1)
        return F.when(twice, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)
    return F.aggregate(F.transform(d, weigh), F.lit(0), lambda a, x: a + x)


def _mod97(compact: Column) -> Column:
    """Remainder by 97 of digits and capital letters, letters counting from 10."""
    return F.aggregate(_chars(compact), F.lit(0), lambda a, c: F.when(c == "", a).when(
        c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _compact(m: Column) -> Column:
    return F.regexp_replace(m, " ", "")


def _valid_iban(m: Column) -> Column:
    c = _compact(m)
    return _mod97(F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))) == 1


def kind_of(m: Column) -> Column:
    """Kind of a mention that the patterns found; null for a number that looks
    like a card or an IBAN but fails its check digits."""
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    return (F.when(whole("email"), "email").when(whole("ip"), "ip").when(whole("ssn"), "ssn")
            .when(whole("phone"), "phone")
            .when(whole("card"), F.when(_luhn_sum(_digits(m), False) % 10 == 0, "card"))
            .when(whole("ipv6"), "ipv6").when(whole("iban"), F.when(_valid_iban(m), "iban"))
            .when(whole("name"), "name").otherwise("secret"))


def _hex_only(m: Column) -> Column:
    return m.rlike("^[0-9a-f]+$|^[0-9A-F]+$")


def _name_tokens(m: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(m, rf"^(?:{_TITLE})\.? ", ""), F.lit(r"(\p{L}+)"), F.lit(1))


def _gender(m: Column) -> Column:
    """By the longest title that the mention begins with."""
    title = F.regexp_extract(m, rf"^({_TITLE})\.? ", 1)
    return F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f").otherwise("n")


def entities(m: Column) -> Column:
    """``array<struct<kind,canon>>`` of one mention: the parts that get surrogates."""
    one = lambda k, c: F.array(F.struct(k.alias("kind"), c.alias("canon")))
    none = F.array().cast("array<struct<kind:string,canon:string>>")

    def names(tokens):
        return F.transform(tokens, lambda t, i: F.struct(
            F.when(i == F.size(tokens) - 1, F.lit("family")).otherwise(F.concat(F.lit("given-"), _gender(m))).alias("kind"),
            F.lower(t).alias("canon")))

    def of(kind):
        canon = (F.when(kind.isin("email", "ipv6"), F.lower(m)).when(kind == "iban", _compact(m)).when(kind == "phone", _right(_digits(m), 10))
                 .when(kind == "card", _digits(m)).when((kind == "secret") & _hex_only(m), F.lower(m)).otherwise(m))
        return (F.when(kind.isNull(), none).when(kind == "name", _let(_name_tokens(m), names))
                .otherwise(one(kind, canon)))

    return _let(kind_of(m), of)


def _right(x: Column, n: int) -> Column:
    return F.when(F.length(x) <= n, x).otherwise(F.substr(x, F.length(x) - n + 1))


def _stream(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """256 keyed hexadecimal digits for an entity."""
    seed = F.concat_ws("|", F.lit(key), kind, draw.cast("string"), canon)
    return F.concat(F.sha2(F.concat(seed, F.lit("|0")), 512), F.sha2(F.concat(seed, F.lit("|1")), 512))


def _byte(h: Column, i: Column | int) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(h, 2 * (i % 128) + 1, F.lit(2)), 16, 10).cast("int")


def _letter(b: Column, size) -> Column:
    return F.char((97 + b % size).cast("bigint"))


def _by_class(m: Column, h: Column, letters=26) -> Column:
    def swap(c, i):
        b = _byte(h, i)
        return (F.when(c.rlike("^[0-9]$"), (b % 10).cast("string"))
                .when(c.rlike("^[a-z]$"), _letter(b, letters))
                .when(c.rlike("^[A-Z]$"), F.upper(_letter(b, letters))).otherwise(c))
    return F.array_join(F.transform(_chars(m), swap), "")


def _by_script(m: Column, h: Column, letters: int) -> Column:
    """Every letter and digit by one of its script and case; without any, symbols by
    ASCII symbols, so that no secret stays what it is."""
    mask = ~m.rlike(r"[\p{L}\p{N}]")

    def swap(c, i):
        b = _byte(h, i)
        of = lambda own: F.substr(F.lit(own), (b * 256 + _byte(h, i + 1)) % len(own) + 1, F.lit(1))
        out = (F.when(c.rlike("^[0-9]$"), (b % 10).cast("string"))
               .when(c.rlike("^[a-z]$"), _letter(b, letters))
               .when(c.rlike("^[A-Z]$"), F.upper(_letter(b, letters))).when(mask & (c != ""), of(_SYMBOLS)))
        for name, (first, n) in _SCRIPTS.items():
            own = of("".join(map(chr, range(first, first + n))))
            out = out.when(c.rlike(rf"^\p{{Is{name}}}$") & c.rlike(r"^\p{L}$"),
                           F.when(c.rlike(r"^\p{Lu}$"), F.upper(own)).otherwise(own))
        return (out.when(c.rlike(r"^\p{Lu}$"), F.upper(_letter(b, letters))).when(c.rlike(r"^\p{L}$"), _letter(b, letters))
                .when(c.rlike(r"^\p{N}$"), (b % 10).cast("string")).otherwise(c))

    # ASCII secrets, nearly all of them, need none of the scripts
    plain = ~mask & m.rlike(r"^\p{ASCII}*$")
    return F.when(plain, _by_class(m, h, letters)).otherwise(F.array_join(F.transform(_chars(m), swap), ""))


def _secret(m: Column, h: Column, draw: Column) -> Column:
    """Letters and digits by script and case (hexadecimal ones stay so); after
    ``PATIENCE`` draws it grows."""
    hexadecimal = _hex_only(m)
    new = F.when(hexadecimal, _by_script(m, h, 6)).otherwise(_by_script(m, h, 26))
    tail = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(draw / PATIENCE).cast("int")), lambda i: F.when(
        i == 0, "").otherwise(_letter(_byte(h, 127 - i), F.when(hexadecimal, 6).otherwise(26)))), "")
    return F.concat(new, F.when(m.rlike("[A-Z]") & ~m.rlike("[a-z]"), F.upper(tail)).otherwise(tail))


def _filled(m: Column, digits: Column) -> Column:
    """The mention with its digits replaced by those of a digit string."""
    def fill(new):
        def put(c, i):
            before = F.length(_digits(F.substr(m, F.lit(1), i + 1)))
            return F.when(c.rlike("^[0-9]$"), F.substr(new, before, F.lit(1))).otherwise(c)
        return F.array_join(F.transform(_chars(m), put), "")
    return _let(digits, fill)


def _email(m: Column, h: Column, draw: Column) -> Column:
    """Letters and digits by class, top-level domain kept; after ``PATIENCE``
    draws the local part grows, for short addresses may all be taken."""
    host = F.substring_index(m, ".", -1)
    more = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(draw / PATIENCE).cast("int")),
                                    lambda i: F.when(i == 0, "").otherwise(_letter(_byte(h, 127 - i), 26))), "")
    return F.concat(more, _by_class(F.substr(m, F.lit(1), F.length(m) - F.length(host)), h), host)


def _ip(m: Column, h: Column, draw: Column) -> Column:
    """Octets of the same length; after ``PATIENCE`` draws of any length."""
    octet = lambda o, i: F.when(draw >= PATIENCE, _byte(h, i)).when(
        F.length(o) == 1, _byte(h, i) % 10).when(
        F.length(o) == 2, 10 + _byte(h, i) % 90).otherwise(100 + _byte(h, i) % 156).cast("string")
    return F.array_join(F.transform(F.split(m, r"\."), octet), ".")


def _ipv6(m: Column, h: Column, draw: Column) -> Column:
    """Groups of the same length, the first one's kind kept; after ``PATIENCE``
    draws the others have four digits."""
    def group(g, i):
        n = F.when((draw >= PATIENCE) & (i > 0), 4).otherwise(F.length(g))
        own = F.substr(h, 4 * i + 1, n)
        return F.when(g == "", g).when(i == 0, F.concat(F.substr(F.lower(g), F.lit(1), F.lit(2)), F.substr(own, F.lit(3)))).otherwise(own)
    return _let(F.array_join(F.transform(F.split(m, ":"), group), ":"), lambda new: F.when(
        m.rlike("[A-F]"), F.upper(new)).otherwise(new))


def _iban(m: Column, h: Column) -> Column:
    """Another account of the country, with its check digits; blanks stay."""
    def checked(compact, body):
        country = F.substr(compact, F.lit(1), F.lit(2))
        rest = 98 - _mod97(F.concat(body, country, F.lit("00")))
        return F.concat(country, F.lpad(rest.cast("string"), 2, "0"), body)

    def spaced(new):
        def put(c, i):
            return F.when(c == " ", c).when(c == "", c).otherwise(
                F.substr(new, F.length(_compact(F.substr(m, F.lit(1), i + 1))), F.lit(1)))
        return F.array_join(F.transform(_chars(m), put), "")

    return _let(_let(_compact(m), lambda c: _let(_by_class(F.substr(c, F.lit(5)), h), lambda b: checked(c, b))), spaced)


def _phone(m: Column, h: Column) -> Column:
    def new(d):
        def swap(c, i):
            r = F.length(d) - 1 - i  # place from the right
            n = F.when((r == 9) | (r == 6), 2 + _byte(h, r) % 8).otherwise(_byte(h, r) % 10)
            return F.when((r >= 10) | (c == ""), c).otherwise(n.cast("string"))
        return F.array_join(F.transform(_chars(d), swap), "")
    return _filled(m, _let(_digits(m), new))


def _card(m: Column, h: Column) -> Column:
    def body(d):
        return F.array_join(F.transform(
            _chars(F.substr(d, F.lit(1), F.length(d) - 1)),
            lambda c, i: F.when((i == 0) | (c == ""), c).otherwise((_byte(h, i) % 10).cast("string"))), "")
    def checked(b):
        return F.concat(b, ((10 - _luhn_sum(b, True) % 10) % 10).cast("string"))
    return _filled(m, _let(_let(_digits(m), body), checked))


def _name_part(kind: Column, token: Column, h: Column, draw: Column) -> Column:
    """An invented name in the token's script; further draws add syllables."""
    pick = lambda own, b: F.element_at(F.array(*[F.lit(x) for x in own]), b % len(own) + 1)

    def made(script):
        middle = F.array_join(F.transform(F.sequence(F.lit(1), 2 + draw), lambda i: pick(_MIDDLE[script], _byte(h, i))), "")
        last = F.lit("")
        for k, own in _LAST[script].items():
            last = F.when(kind == k, pick(own, _byte(h, 0))).otherwise(last)
        return F.concat(pick(_FIRST[script], _byte(h, 100)), middle, last)

    return (F.when(token.rlike(r"^\p{IsCyrillic}"), made("cyrillic"))
            .when(token.rlike(r"^\p{IsGreek}"), made("greek")).otherwise(made("latin")))


def _formed(kind: Column, m: Column, h: Column, draw: Column) -> Column:
    """Surrogate of a mention that is one entity (not a name)."""
    return (F.when(kind == "email", _email(m, h, draw)).when(kind == "ip", _ip(m, h, draw))
            .when(kind == "ipv6", _ipv6(m, h, draw)).when(kind == "iban", _iban(m, h))
            .when(kind == "phone", _phone(m, h)).when(kind == "card", _card(m, h))
            .when(kind == "secret", _secret(m, h, draw)).otherwise(_by_class(m, h)))


_NAME_KINDS = ["family", "given-m", "given-f", "given-n"]


def surrogate(m: Column, key: str, draw_of) -> Column:
    """``struct<kind,surrogate>`` of a mention; what is no entity stays as it is,
    with the kind ``none``. ``draw_of(kind, canon)``: how often the entity was
    drawn again. Each step's values are computed once for the next."""
    def seeded(e):
        drawn = F.transform(e, lambda x: F.struct(x.kind.alias("kind"), x.canon.alias("canon"),
                                                  draw_of(x.kind, x.canon).alias("draw")))
        return F.transform(drawn, lambda x: F.struct(
            x.kind.alias("kind"), x.draw.alias("draw"), _stream(key, x.kind, x.canon, x.draw).alias("h")))

    def names(e):
        title = F.regexp_extract(m, rf"^((?:{_TITLE})\.? )", 1)
        def of(tokens):
            return F.array_join(F.transform(e, lambda x, i: _name_part(x.kind, F.get(tokens, i), x.h, x.draw)), " ")
        return F.concat(title, _let(_name_tokens(m), of))

    def made(e):
        first = F.get(e, F.lit(0))
        named = first.kind.isin(_NAME_KINDS)
        return F.struct(
            F.when(F.size(e) == 0, "none").when(named, "name").otherwise(first.kind).alias("kind"),
            F.when(F.size(e) == 0, m).when(named, names(e))
            .otherwise(_formed(first.kind, m, first.h, first.draw)).alias("surrogate"))

    return _let(_let(entities(m), seeded), made)


def _entity_surrogate(kind: Column, canon: Column, key: str, draw: Column) -> Column:
    """Canonical form of an entity's surrogate, for the collision check."""
    return _let(_stream(key, kind, canon, draw), lambda h: F.when(
        kind.isin(_NAME_KINDS), F.lower(_name_part(kind, canon, h, draw))).otherwise(_formed(kind, canon, h, draw)))


def _mentions(text: Column) -> Column:
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def _untitled(text: Column, mentions: Column, made: Column) -> Column:
    """``struct<text,found>``: the text with the whole names of titled mentions
    replaced where they stand without a title, longest names first (for one name the
    first mention's surrogate), and those replaced. ``text`` has the titled mentions'
    surrogates already."""
    bare = lambda x: F.regexp_replace(x, rf"^(?:{_TITLE})\.? ", "")
    named = F.transform(mentions, lambda m, i: F.struct(
        (-F.length(bare(m))).alias("order"), i.alias("i"), bare(m).alias("person"), F.get(made, i).kind.alias("kind"),
        bare(F.get(made, i).surrogate).alias("new")))
    own = F.array_sort(F.filter(named, lambda x: (x.kind == "name") & x.person.rlike(r"\p{L}[ \-]\p{L}")))
    none = F.array().cast("array<struct<kind:string,surrogate:string>>")

    def put(a, x):
        place = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), x.person, F.lit(r"(?![\p{L}\p{N}])"))
        again = F.array_repeat(F.struct(F.lit("name").alias("kind"), x.new.alias("surrogate")), F.regexp_count(a.text, place))
        return F.struct(F.regexp_replace(a.text, place, x.new).alias("text"), F.concat(a.found, again.cast(
            "array<struct<kind:string,surrogate:string>>")).alias("found"))

    return F.aggregate(own, F.struct(text.alias("text"), none.alias("found")), put)


def redrawn(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``(kind, canon, draw)`` of the entities whose first surrogate collides: it is
    another entity's surrogate, or an entity of the corpus. One row per distinct
    entity is checked, by grouping and joining on surrogates."""
    found = docs.select(F.explode(_mentions(F.col("text"))).alias("m")).distinct().select(
        F.explode(entities(F.col("m"))).alias("e")).select("e.kind", "e.canon").distinct()
    state = stored(found.withColumn("draw", F.lit(0)))
    while True:
        drawn = state.withColumn("s", _entity_surrogate(F.col("kind"), F.col("canon"), key, F.col("draw")))
        shared = drawn.groupBy("kind", "s").agg(
            F.count("*").alias("n"), F.min(F.struct("draw", "canon")).alias("first")).where("n > 1").select(
            "kind", "s", F.col("first.canon").alias("stays"))
        taken = state.select("kind", F.col("canon").alias("s"), F.lit(True).alias("taken"))
        marked = drawn.join(shared, ["kind", "s"], "left").join(taken, ["kind", "s"], "left").select(
            "kind", "canon", "draw",
            (F.coalesce(F.col("taken"), F.lit(False)) | F.coalesce(F.col("stays") != F.col("canon"), F.lit(False))).alias("again"))
        marked = stored(marked)
        left = marked.where("again").agg(F.count("*").alias("n"), F.max("draw").alias("draw"),
                                         F.max("kind").alias("kind")).first()
        if not left["n"]:
            return marked.where("draw > 0").select("kind", "canon", "draw")
        if left["draw"] >= MOST_DRAWS:
            raise ValueError(f"{left['n']} entities (such as of kind {left['kind']}) have no surrogate that is free")
        state = marked.select("kind", "canon", (F.col("draw") + F.col("again").cast("int")).alias("draw"))


def replace(docs: DataFrame, key: str = KEY, inline: int = INLINE_DRAWS) -> DataFrame:
    """``docs`` with surrogates in ``text``, plus ``n_entities bigint`` and
    ``entities array<struct<kind,surrogate>>`` in order of the text, names found again
    without a title after the others.

    One row per input row. A null text stays null, without entities; texts without
    entities are unchanged. Columns of ``docs`` with the new names are replaced.
    The key decides all surrogates; rows and partitions don't matter.
    """
    again = redrawn(docs, key)
    n = again.limit(inline + 1).count()
    df = docs.withColumn("_m", _mentions(F.col("text")))
    if n <= inline:
        pairs = again.collect()  # at most ``inline`` rows
        if pairs:
            draws = F.create_map(*[F.lit(x) for r in pairs for x in (f"{r['kind']}:{r['canon']}", r["draw"])])
            draw_of = lambda kind, canon: F.coalesce(F.element_at(draws, F.concat_ws(":", kind, canon)), F.lit(0))
        else:
            draw_of = lambda kind, canon: F.lit(0)
    else:
        # more than that: look them up by a join, and bring each text its own
        df = df.withColumn("_row", F.xxhash64("text"))
        own = (df.where(F.size("_m") > 0).select("_row", F.explode(F.array_distinct(F.flatten(
            F.transform("_m", entities)))).alias("e")).distinct().select("_row", "e.kind", "e.canon")
            .join(again, ["kind", "canon"]).groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct(
                F.concat_ws(":", "kind", "canon"), "draw"))).alias("_draws")))
        df = df.join(own, "_row", "left")
        draw_of = lambda kind, canon: F.coalesce(
            F.element_at(F.col("_draws"), F.concat_ws(":", kind, canon)), F.lit(0))
    made = F.transform("_m", lambda m: surrogate(m, key, draw_of))
    df = df.withColumn("_s", F.when(F.size("_m") > 0, made))
    whole = _let(F.split(F.col("text"), _ANY, -1), lambda pieces: F.concat(
        F.get(pieces, F.lit(0)), F.array_join(F.transform(
            "_s", lambda s, i: F.concat(s.surrogate, F.get(pieces, i + 1))), "")))
    real = F.concat(F.filter("_s", lambda s: s.kind != "none"), F.col("_t.found"))
    df = df.withColumn("_t", F.when(F.size("_m") > 0, _untitled(whole, F.col("_m"), F.col("_s"))))
    found = F.when(F.col("_s").isNull(), F.array().cast("array<struct<kind:string,surrogate:string>>")).otherwise(real)
    out = [F.when(F.col("_t").isNull(), F.col("text")).otherwise(F.col("_t.text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns
           if c.lower() not in ("n_entities", "entities")]
    return df.select(*out, F.size(found).cast("bigint").alias("n_entities"), found.alias("entities"))
