"""Titles as keys: folding, readings, one-edit distance, scripts, and sortable versions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other alphabets in the shape of Latin ones; letters that folding spells out and symbols that are words; umlauts as a
# keyboard spells them; articles.
LOOK_ALIKE = (
    "АВЕКМНОРСТУХЅІЈԚԜ" "аеорсухѕіјԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ον",
    "ABEKMHOPCTYXSIJQW" "aeopcyxsijqw" "ABEZHIKMNOPTYX" "ov",
)
SPELLED = (
    ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("ß", "ss"), ("ẞ", "SS"), ("Þ", "TH"), ("þ", "th"), ("Ø", "O"), ("ø", "o"), ("Ð", "D"), ("ð", "d"), ("Đ", "D"), ("đ", "d"),
    ("Ł", "L"), ("ł", "l"), ("Ħ", "H"), ("ħ", "h"), ("Ŧ", "T"), ("ŧ", "t"), ("Ŋ", "N"), ("ŋ", "n"), ("ı", "i"), ("ȷ", "j"), ("ſ", "s"),
    ("&", " and "), ("＆", " and "), ("+", " plus "), ("＋", " plus "), ("@", " at "),
)
KEYBOARD = (("ä", "ae"), ("Ä", "Ae"), ("ö", "oe"), ("Ö", "Oe"), ("ü", "ue"), ("Ü", "Ue"), ("å", "aa"), ("Å", "Aa"), ("ø", "oe"), ("Ø", "Oe"))
ARTICLES = (
    "the", "a", "an", "le", "la", "les", "l", "un", "une", "des", "du", "de", "der", "die", "das", "den", "dem", "ein", "eine", "einer",
    "einen", "het", "een", "el", "los", "las", "una", "unos", "unas", "il", "lo", "gli", "i", "uno", "o", "os", "as",
)
SHORTEST_NEAR = 6
MOST_READINGS = 128


def _plain_letters() -> tuple[str, str]:
    """Characters of the basic plane that are one ASCII letter or digit when decomposed, and those; then the combining marks, for none."""
    out = {}
    for code in range(0xA0, 0x10000):
        text = unicodedata.normalize("NFKD", chr(code))
        text = "".join(c for c in text if unicodedata.category(c) != "Mn")
        if len(text) == 1 and text.isascii() and text.isalnum():
            out[chr(code)] = text
    return "".join(out) + "".join(map(chr, range(0x300, 0x370))), "".join(out.values())


_PLAIN = _plain_letters()
# Characters that are several letters when decomposed.
_SEVERAL = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ĳ", "ij"), ("Ĳ", "IJ"), ("ǆ", "dz"), ("ǉ", "lj"), ("ǌ", "nj"), ("ǳ", "dz"), ("Ǆ", "DZ"), ("Ǉ", "LJ"), ("Ǌ", "NJ"), ("Ǳ", "DZ"), ("½", "1 2"), ("¼", "1 4"), ("¾", "3 4"), ("™", "TM"), ("№", "No"))


def strip_accents(text: Column) -> Column:
    """Accents dropped from Latin letters, by one translation in the JVM."""
    return F.translate(_spell(text, _SEVERAL), *_PLAIN)


def _spell(text: Column, table: tuple) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), table, text)


def fold(text: Column) -> Column:
    """Lower case ASCII words with single spaces."""
    plain = F.lower(strip_accents(_spell(F.translate(text, *LOOK_ALIKE), SPELLED)))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def fold_ascii(text: Column) -> Column:
    """``fold`` for text known to be ASCII, with no Python in the plan."""
    return F.trim(F.regexp_replace(F.lower(_spell(text, tuple(p for p in SPELLED if p[0].isascii()))), "[^a-z0-9]+", " "))


def without_article(folded: Column) -> Column:
    return F.regexp_replace(folded, rf"^({'|'.join(ARTICLES)}) (?=.)", "")


def title_keys(text: Column) -> Column:
    """Up to four distinct keys of a title: folded and keyboard-spelled, each with and without its leading article, spaces dropped."""
    folded, spelled = fold(text), fold(_spell(text, KEYBOARD))
    keys = F.array(*[F.replace(k, F.lit(" "), F.lit("")) for k in (folded, without_article(folded), spelled, without_article(spelled))])
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


# Conjunctions by what they are read as, labels before, in and after a title, and words that label a number.
CONJUNCTIONS = {"and": "and und et en y e ed i og och ja a es si ve to".split(), "vs": "vs v versus gegen contre".split()}
FILLERS = "movie movies film filme films feature featurefilm featurette featurettes special specials fullmovie thefilm themovie".split()
LABELS = "movie film themovie thefilm documentary documentaries thedocumentary doku dokumentation docu documentaire documental documentario".split()
LAST_LABELS = ["live"]
NUMBER_LABELS = "part parts pt teil chapter chapitre kapitel vol volume deel parte episode episodio epizoda".split()

# Number words, spelled as their language spells them, from the number that begins a list; a dash stands for none. Words that are
# articles, conjunctions or ordinary words elsewhere are left out.
NUMBER_WORDS = {
    "English": (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"),
    "German": (1, "eins zwei drei vier fünf sechs sieben acht neun zehn - zwölf - - - - - - - zwanzig"),
    "French": (2, "deux trois quatre cinq - sept huit neuf - - douze treize quatorze quinze - - - - vingt"),
    "Dutch": (2, "twee drie - vijf zes zeven - negen tien - twaalf - - - - - - - twintig"),
    "Spanish": (2, "dos tres cuatro cinco seis siete ocho nueve diez - doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte"),
    "Italian": (3, "tre quattro cinque - sette - nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove venti"),
    "Portuguese": (2, "dois - quatro - - sete oito - dez - doze treze - - dezasseis dezassete dezoito dezenove vinte"),
    "Portuguese, other forms": (2, "duas - - - - - - - - - - - - - dezesseis dezessete"),
    "Polish": (1, "jeden dwa trzy cztery pięć sześć siedem osm dziewięć dziesięć jedenaście dwanaście trzynaście czternaście piętnaście szesnaście siedemnaście osiemnaście dziewiętnaście dwadzieścia"),
    "Polish, other forms": (1, "jedna dwie"),
    "Swedish": (2, "två - fyra fem - sju åtta nio tio elva tolv tretton fjorton femton sexton sjutton arton nitton tjugo"),
    "Danish": (4, "fire - seks syv otte ni ti - - tretten fjorten - seksten sytten atten nitten tyve"),
    "Norwegian": (7, "syve atte - - - - - - - - - atty - tjue"),
    "Norwegian, other forms": (8, "ætte - - - - - - - - - - - tju"),
    "Norwegian, third forms": (8, "att"),
    "Finnish": (2, "kaksi kolme neljä viisi kuusi seitsemän kahdeksan yhdeksän kymmenen - - - - - - - - - kaksikymmentä"),
    "Czech": (2, "dve tri čtyři - šest sedm - devět deset jedenáct dvanáct třináct čtrnáct patnáct šestnáct sedmnáct osmnáct devětenáct dvacet"),
    "Hungarian": (2, "kettő három négy öt - - nyolc kilenc tíz - - - - - - - - - húsz"),
    "Turkish": (2, "iki üç dört beş altı yedi sekiz dokuz - - - - - - - - - - yirmi"),
}
# Teens that are stems of 11 to 19 or a part of them, with an ending or a beginning.
TEENS = {
    "German": (13, "drei vier fünf sech sieb acht neun", "{}zehn"),
    "Dutch": (13, "der veer vijf zes zeven acht negen", "{}tien"),
    "Finnish": (11, "yksi kaksi kolmi neljä viisi kuusi seitsemän kahdeksan yhdeksän", "{}toista"),
    "Hungarian": (11, "egy kettő három négy öt hat hét - kilenc", "tizen{}"),
}
ROMAN = "^(?=.)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
ROMAN_LETTERS = (("m", 1000), ("d", 500), ("c", 100), ("l", 50), ("x", 10), ("v", 5), ("i", 1))
SUBTITLE = r"\s[-–—]\s|:\s|\s\|\s|\s\("


def number_words() -> dict[str, int]:
    """Each number word as the fold leaves it, accents dropped and also spelled out as a keyboard does."""
    out = {}
    for table, shape in ((NUMBER_WORDS, "{}"), *((({k: v[:2]}), v[2]) for k, v in TEENS.items())):
        for first, listed in table.values():
            for n, word in enumerate(listed.split(), first):
                for spelled in (word, _replaced(word, KEYBOARD)) if word != "-" else ():
                    out[_folded(shape.format(spelled))] = n
    return out


def _replaced(text: str, table: tuple) -> str:
    return reduce(lambda t, pair: t.replace(*pair), table, text)


def _folded(word: str) -> str:
    plain = unicodedata.normalize("NFKD", _replaced(word, SPELLED))
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def _words(text: Column) -> Column:
    return F.filter(F.split(fold(text), " "), lambda w: w != "")


def _ordinal(word: Column) -> Column:
    """A number, but not a year."""
    return word.rlike("^[0-9]+$") & ~word.rlike("^[12][0-9]{3}$")


def _figure(word: Column) -> Column:
    """A numeral or number word in figures; other words as they are."""
    value = lambda c: reduce(lambda rest, pair: F.when(c == pair[0], pair[1]).otherwise(rest), ROMAN_LETTERS, F.lit(0))
    add = lambda s, v: F.struct((s["sum"] + v - F.when(s["last"] < v, s["last"] * 2).otherwise(0)).alias("sum"), v.alias("last"))
    roman = F.aggregate(F.split(word, ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, c: add(s, value(c)))["sum"]
    numbers = number_words()
    known = F.create_map(*[F.lit(x) for item in numbers.items() for x in item])
    # a set answers for the many words that are none before the map is searched
    figure = F.when(word.isin(*numbers), F.try_element_at(known, word).cast("string"))
    return F.when(word.rlike(ROMAN), roman.cast("string")).otherwise(F.coalesce(figure, word))


def figures(words: Column) -> Column:
    return F.transform(words, _figure)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _if(test: Column, words: Column, otherwise: Column) -> Column:
    return F.when(test, words).otherwise(otherwise)


def _one_conjunction(w: Column) -> Column:
    inner = lambda i: (i > 0) & (i < F.size(w) - 1)
    read = lambda x: reduce(lambda rest, pair: F.when(x.isin(pair[1]), pair[0]).otherwise(rest), CONJUNCTIONS.items(), x)
    return F.transform(w, lambda x, i: F.when(inner(i), read(x)).otherwise(x))


def _no_article(w: Column) -> Column:
    several, n = F.size(w) > 1, F.size(w)
    last = _if(several & F.element_at(w, -1).isin(*ARTICLES), F.slice(w, F.lit(1), n - 1), w)
    return _if(several & F.get(w, F.lit(0)).isin(*ARTICLES), F.slice(w, F.lit(2), n), last)


def _no_articles(w: Column) -> Column:
    kept = F.filter(w, lambda x: ~x.isin(*ARTICLES))
    return _if(F.size(kept) >= 2, kept, w)


def _no_filler(w: Column) -> Column:
    title = F.array_position(F.transform(w, lambda x: ~x.isin(*FILLERS)), True).cast("int")
    return F.slice(w, F.when(title == 0, F.greatest(F.size(w), F.lit(1))).otherwise(title), F.size(w))


def _no_label(w: Column) -> Column:
    kept = F.filter(w, lambda x, i: (i == 0) | ~x.isin(*LABELS))
    ended = lambda k: _if((F.size(k) > 2) & F.element_at(k, -1).isin(*LAST_LABELS), F.slice(k, F.lit(1), F.size(k) - 1), k)
    return let(let(kept, ended), lambda k: _if(F.size(k) > 1, k, w))


def _no_possessive(w: Column) -> Column:
    kept = F.filter(w, lambda x: x != "s")
    return _if(F.size(kept) > 0, kept, w)


def _no_number_label(w: Column) -> Column:
    """A label goes where a number stands beside it, unless that is a 1 at the end, which a title may leave out itself."""

    def numbers(at: Column) -> Column:
        beside = F.get(w, at)
        return F.coalesce(_ordinal(beside) & ~((beside == "1") & (at == F.size(w) - 1)), F.lit(False))

    kept = F.filter(w, lambda x, i: ~(x.isin(*NUMBER_LABELS) & (numbers(i - 1) | numbers(i + 1))))
    return _if(F.size(kept) > 1, kept, w)


def _no_first(w: Column) -> Column:
    return _if((F.size(w) > 1) & (F.element_at(w, -1) == "1"), F.slice(w, F.lit(1), F.size(w) - 1), w)


def _no_inner_number(w: Column) -> Column:
    kept = F.filter(w, lambda x, i: (i == 0) | (i == F.size(w) - 1) | ~_ordinal(x))
    return _if(F.size(kept) > 1, kept, w)


#: Rewritings of a title's words, each applied to what those before it left; a title may be meant with or without any of them.
REWRITINGS = (_one_conjunction, _no_article, _no_articles, _no_filler, _no_label, _no_possessive, figures, _no_number_label, _no_first, _no_inner_number)


def _no_subtitle(title: Column) -> Column:
    """The words of a title up to the first break that follows a number in its series, with the years of the rest; all words if there is none."""
    def cut(parts: Column) -> Column:
        head = lambda n: F.flatten(F.slice(parts, F.lit(1), n))
        told = lambda n: let(let(figures(head(n)), _no_number_label), lambda w: (F.size(w) > 1) & _ordinal(F.element_at(w, -1)))
        breaks = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        years = lambda n: F.filter(F.flatten(F.slice(parts, n + 1, F.size(parts))), lambda x: x.rlike("^[12][0-9]{3}$"))
        return let(F.get(F.filter(breaks, told), F.lit(0)), lambda n: F.when(n.isNotNull(), F.concat(head(n), years(n))).otherwise(F.flatten(parts)))

    return let(F.transform(F.split(title, SUBTITLE), lambda p: _words(p)), cut)


def title_forms(title: Column) -> Column:
    """The word lists that a title may be written as: every rewriting applied to all that the earlier ones made, at most ``MOST_READINGS``.

    The lists start from the title and from its umlauts spelled out, each whole and without a numbered title's subtitle. One fold over the
    rewritings in the JVM: what a step made is bound once, so the expression does not grow with the number of forms.
    """
    spelled = _spell(title, KEYBOARD)
    seeds = F.array_distinct(F.array(_words(title), _no_subtitle(title), _words(spelled), _no_subtitle(spelled)))

    def step(forms: Column, i: Column) -> Column:
        def rewrite(w: Column) -> Column:
            return reduce(lambda rest, pair: F.when(i == pair[0], pair[1](w)).otherwise(rest), enumerate(REWRITINGS), w)

        made = F.filter(F.transform(forms, rewrite), lambda w: F.size(w) > 0)
        return F.slice(F.array_distinct(F.concat(forms, made)), 1, MOST_READINGS)

    return F.when(title.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(len(REWRITINGS) - 1)), seeds, step))


def readings(title: Column) -> Column:
    """Every key that a title may be matched by: its forms, joined by spaces and joined by nothing; at most ``MOST_READINGS``."""
    keys = F.flatten(F.transform(title_forms(title), lambda w: F.array(F.array_join(w, " "), F.array_join(w, ""))))
    return F.slice(F.array_distinct(F.filter(keys, lambda k: k != "")), 1, MOST_READINGS)


# How a name says that another follows, what is left on the edges of both, titles of one name at most, spellings worth asking at most,
# breaks within a title, and umlauts written back from how a keyboard spells them.
ALSO_KNOWN = r"(?i)\s[(\[{]?\s*(?:a\.?\s?k\.?\s?a\.?|a\s*/\s*k\s*/\s*a|also\s+known\s+as)(?=[\s:,.;)\]}-]|$)[\s:,.;–—-]*"
MOST_TITLES, MOST_SPELLINGS = 3, 5
BREAK = r"\s[-–—]\s|:\s|\s\|\s"
WRITTEN_BACK = (("(?<![AaEeQqÄä])ue", "ü"), ("(?<![AaEeQqÄä])Ue", "Ü"), (r"ae(?!la?\b)", "ä"), (r"Ae(?!la?\b)", "Ä"), ("oe", "ö"), ("Oe", "Ö"))


def _closed_up(part: Column) -> Column:
    """One title without separators at its ends, and without a bracket there whose partner is gone."""
    edges = lambda t: F.regexp_replace(t, r"^[ \t\-–—:,;|]+|[ \t\-–—:,;|]+$", "")
    count = lambda t, c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))

    def without(first: str, last: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
        ended = lambda t: F.when(F.endswith(t, F.lit(last)) & (count(t, last) > count(t, first)), edges(F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(t)
        begun = lambda t: F.when(F.startswith(t, F.lit(first)) & (count(t, first) > count(t, last)), edges(F.substring(t, F.lit(2), F.length(t)))).otherwise(t)
        return ended, begun

    return reduce(let, [rule for pair in ("()", "[]", "{}") for rule in without(*pair)], edges(part))


def titles_together(name: Column) -> Column:
    """The titles that a name says it has, left to right, at most three; none where it is one title or a part of it would be no title."""
    parts = F.transform(F.split(name, ALSO_KNOWN, -1), _closed_up)
    none = F.array().cast("array<string>")
    return let(parts, lambda p: F.when((F.size(p) > 1) & F.forall(p, lambda t: fold(t) != ""), F.slice(p, 1, MOST_TITLES)).otherwise(none))


def _parts(title: Column) -> Column:
    return F.filter(F.split(title, r"\s+"), lambda w: w != "")


def _without_labels(words: Column) -> Column:
    """Written words without labels behind the first, an article before one, and a last label with the separators it leaves."""
    empty = F.array().cast("array<string>")

    def step(kept: Column, x: Column) -> Column:
        label = (x["i"] > 0) & fold(x["w"]).isin(*LABELS)
        article = F.coalesce(fold(F.get(kept, F.size(kept) - 1)).isin(*ARTICLES), F.lit(False))
        return F.when(~label, F.array_append(kept, x["w"])).when(article, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)

    def ended(k: Column) -> Column:
        rest = F.regexp_replace(F.array_join(F.slice(k, F.lit(1), F.size(k) - 1), " "), r"[ \-:–—|]+$", "")
        return F.when((F.size(k) > 2) & fold(F.element_at(k, -1)).isin(*LAST_LABELS), _parts(rest)).otherwise(k)

    return let(F.aggregate(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), empty, step), ended)


def search_spellings(title: Column) -> Column:
    """The spellings to ask a catalogue under, the written one first, at most five; of those that fold to the same only the first."""
    filler = "|".join(FILLERS)
    bare = F.regexp_replace(title, rf"(?i)^(?:[.:-]*(?:{filler})[.:-]* [ \-:.–—|]*+(?=.))+", "")

    def spellings(t: Column) -> Column:
        tail = F.trim(F.element_at(F.split(t, BREAK, -1), -1))
        says = F.exists(figures(_words(tail)), lambda w: ~(w.rlike("^[0-9]+$") | w.isin(*NUMBER_LABELS)))
        words = _parts(t)
        plain, counted = _without_labels(words), F.transform(words, lambda w: let(F.lower(w), lambda x: F.when(_figure(x) != x, _figure(x)).otherwise(w)))
        last = F.element_at(words, -1)
        return F.array(
            t,
            reduce(lambda u, pair: F.regexp_replace(u, *pair), WRITTEN_BACK, t),
            F.when((tail != "") & (tail != F.trim(t)) & says, tail),
            F.when(F.size(plain) > 1, F.array_join(plain, " ")),
            F.array_join(counted, " "),
            F.when((F.size(words) > 1) & F.lower(last).isin("i", "1"), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")),
            fold(title),
        )

    every = F.concat(F.array(title), let(bare, spellings))
    folded = F.transform(every, lambda t: F.struct(F.coalesce(fold(t), F.lit("")).alias("f"), t.alias("t")))
    # the written title leads even if nothing of it folds
    new = lambda all_: F.filter(all_, lambda x, i: (i == 0) | ((x["f"] != "") & ~F.exists(F.slice(all_, F.lit(1), i), lambda y: y["f"] == x["f"])))
    return F.when(title.isNotNull(), F.slice(F.transform(let(folded, new), lambda x: x["t"]), 1, MOST_SPELLINGS))


def one_edit(a: Column, b: Column) -> Column:
    """Whether one substitution, insertion, deletion or swap of neighbours makes one of the other."""
    swapped = lambda i: F.concat(a.substr(F.lit(1), i - 1), a.substr(i + 1, F.lit(1)), a.substr(i, F.lit(1)), a.substr(i + 2, F.length(a)))
    places = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    return (F.levenshtein(a, b, 2) == 1) | ((F.length(a) == F.length(b)) & (a != b) & F.exists(places, lambda i: swapped(i) == b))


def near_blocks(key: Column) -> Column:
    """Block keys of which two keys one edit apart share one: the key, and the key with one character left out.

    There are as many as the key is long, so a join on them grows with the keys and not with their square. Short keys have none.
    """
    places = F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1)))
    shorter = F.transform(places, lambda i: F.concat(key.substr(F.lit(1), i - 1), key.substr(i + 1, F.length(key))))
    return F.when(F.length(key) >= SHORTEST_NEAR, F.array_distinct(F.concat(F.array(key), shorter))).otherwise(F.array().cast("array<string>"))


def word_runs(folded: Column, least: int = 3) -> Column:
    """The beginnings and ends of a folded title, not all of it, that hold ``least`` words or more besides articles."""
    words = F.split(folded, " ")
    sizes = F.when(F.size(words) > least, F.sequence(F.lit(least), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    runs = F.concat(F.transform(sizes, lambda n: F.slice(words, 1, n)), F.transform(sizes, lambda n: F.slice(words, -n, n)))
    telling = F.filter(runs, lambda r: F.size(F.filter(r, lambda w: ~w.isin(*ARTICLES))) >= least)
    return F.array_distinct(F.transform(telling, lambda r: F.array_join(r, " ")))


def one_slip(a: Column, b: Column) -> Column:
    """Whether two folded names differ by one slip of a hand, told by what their common beginning and end leave over.

    One letter against another; a letter too many; two neighbouring letters, or a letter and the space beside it, changed in order; a space too many, but not
    between two digits. Digits are never touched, both names have ``SHORTEST_NEAR`` characters, and equal names are no slip.
    """
    letter, digit = lambda c: c.rlike("^[a-z]$"), lambda c: c.rlike("^[0-9]$")
    of = lambda c, side, i: F.get(c[side], i)
    longer = F.length(a) >= F.length(b)
    chars = F.struct(F.split(F.when(longer, a).otherwise(b), "").alias("x"), F.split(F.when(longer, b).otherwise(a), "").alias("y"))
    none = F.lit(False)

    def exchanged(c: Column, off: Column) -> Column:
        """Of equal length: one letter against another, or two neighbours in the other order."""
        p, q = F.get(off, F.lit(0)), F.get(off, F.lit(1))
        first, second = of(c, "x", p), of(c, "x", q)
        kinds = (letter(first) & (letter(second) | (second == " "))) | ((first == " ") & letter(second))
        crossed = (q == p + 1) & (first == of(c, "y", q)) & (second == of(c, "y", p)) & kinds
        return F.when(F.size(off) == 1, letter(first) & letter(of(c, "y", p))).when(F.size(off) == 2, crossed).otherwise(none)

    def surplus(c: Column, place: Column) -> Column:
        """One longer by a character, which stands at the first place that differs."""
        rest = F.slice(c["x"], place + 2, F.size(c["x"])) == F.slice(c["y"], place + 1, F.size(c["x"]))
        counts = (place > 0) & digit(of(c, "x", place - 1)) & F.coalesce(digit(of(c, "x", place + 1)), none)
        return rest & (letter(of(c, "x", place)) | ((of(c, "x", place) == " ") & ~counts))

    def places(c: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(c["y"]) - 1), lambda i: of(c, "x", i) != of(c, "y", i))

    same = let(chars, lambda c: let(places(c), lambda off: exchanged(c, off)))
    more = let(chars, lambda c: let(F.coalesce(F.get(places(c), F.lit(0)), F.size(c["y"])), lambda place: surplus(c, place)))
    long_enough = F.least(F.length(a), F.length(b)) >= SHORTEST_NEAR
    apart = F.abs(F.length(a) - F.length(b))
    return F.when(long_enough & (a != b), F.when(apart == 0, same).when(apart == 1, more).otherwise(none)).otherwise(none)


def is_latin(text: Column) -> Column:
    """At least half of the letters are Latin."""
    return F.regexp_count(text, F.lit(r"\p{IsLatin}")) * 2 >= F.regexp_count(text, F.lit(r"\p{L}"))


def folder_year(name: Column) -> Column:
    return F.regexp_extract(name, r"[(\[]((?:18|19|20)[0-9]{2})[)\]]", 1).try_cast("int")


def segments(title: Column) -> Column:
    """Parts of a title at colons, dashes and slashes."""
    return F.filter(F.transform(F.split(title, r"\s*(?::|\s-\s|–|/)\s*"), lambda t: F.trim(t)), lambda t: t != "")


def without_copy_mark(name: Column) -> Column:
    """`` - Copy (2)`` and ``(2)`` at the end dropped."""
    return F.trim(F.regexp_replace(name, r"(?i)( - copy)?( ?\([0-9]{1,2}\))?$", ""))


#: Endings that a version order holds back, and a character of a name as what orders it: a tilde, the end, letters, and then all others.
SUFFIXES = r"(\.[A-Za-z~][A-Za-z0-9~]*)*$"


def version_key(name: Column) -> Column:
    """What names are ordered by in the order of versions.

    The order is total: names beginning with a dot come first (one and two dots before all), empty names last; then what stands before the
    suffixes, in turns of marks and numbers, numbers by value, a tilde before the end of a name, letters before other marks;
    then the bytes of the name. Digits are those of ASCII.
    """
    dotted = F.startswith(name, F.lit("."))
    rank = F.when(name == "", 5).when(name == ".", 1).when(name == "..", 2).when(dotted, 3).otherwise(4)
    text = F.when(rank == 3, F.substring(name, 2, 1 << 30)).otherwise(name)
    stem = F.regexp_replace(text, SUFFIXES, "")
    stem = F.when(stem == "", text).otherwise(stem)
    # zeros that end the stem count for nothing, as do those before a number
    plain = F.regexp_replace(stem, "(?<![0-9])0+$", "")
    runs = F.regexp_extract_all(F.concat(plain, F.lit("\x00")), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda r: F.regexp_replace(r, "^0+", "")
    number = lambda r: F.concat(F.lpad(F.length(digits(r)).cast("string"), 9, "0"), digits(r))
    # marks are lifted over letters, and the tilde is put under the end
    marks = lambda r: F.translate(F.regexp_replace(r, r"([^A-Za-z~\x00])", "\x7f$1"), "~\x00", "\x01\x02")
    ended = lambda r: F.when(F.endswith(r, F.lit("\x00")), marks(r)).otherwise(F.concat(marks(r), F.lit("\x02")))
    first = F.when(plain.rlike("^[0-9]"), "\x02").otherwise("")
    turns = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), number(r)).otherwise(ended(r)))
    return F.struct(rank.alias("rank"), F.concat(first, F.array_join(turns, ""), F.lit("0" * 9 + "\x02")).alias("turns"), text.alias("text"))
