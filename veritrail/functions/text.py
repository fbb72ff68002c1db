"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no content words.
STOPWORDS = tuple(
    """
    a about above after again against all also am an and any are as at be because been before being below
    between both but by can could did do does doing down during each few for from further had has have having
    he her here hers herself him himself his how i if in into is it its itself just me more most my myself no
    nor not of off on once only or other our ours ourselves out over own same she should so some such than that
    the their theirs them themselves then there these they this those through to too under until up very was we
    were what when where which while who whom whose why will with would you your yours yourself yourselves
    s t don shall may might must per via vs etc many much
    """.split()
)

# Expressions of time that only hold when they are written.
RELATIVE_TIME = (
    r"\b("
    r"yesterday|today|tonight|tomorrow|now|nowadays|currently|current|recent|recently|lately|latest|"
    r"these\s+days|at\s+present|at\s+the\s+moment|right\s+now|so\s+far|to\s+date|up\s+to\s+date|"
    r"(?:this|last|next|past|previous|coming|upcoming)\s+"
    r"(?:few\s+)?(?:day|week|weekend|month|quarter|year|decade|season|spring|summer|autumn|fall|winter)s?|"
    r"(?:a\s+few|several|some|\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+"
    r"(?:day|week|month|year|decade)s?\s+(?:ago|back)|"
    r"ago|most\s+recent(?:ly)?"
    r")\b"
)

# Ways to point at a passage that a retrieval system hasn't got.
PASSAGE_REFERENCE = (
    r"\b(?:according to|based on|in|from|per)\s+(?:the|this|that|given|above|provided)"
    r"(?:\s+(?:given|above|provided))?\s+(?:passage|text|document|context|article|excerpt|paragraph)s?\b"
    r"|\b(?:the|this|that|given|above|provided)\s+(?:passage|excerpt)s?\b"
)

ALNUM = "[a-z0-9]+"
NUMERIC = "[a-z0-9]+(?:[.,][0-9]+)*"
MIN_BIGRAMS = 8
MIN_FACT_WORDS = 3


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens_alnum(text: Column | str) -> Column:
    """Runs of a-z and 0-9 of the text in lower case, in order."""
    return F.regexp_extract_all(F.lower(column(text)), F.lit(ALNUM), F.lit(0))


def raw_numeric(text: Column | str) -> Column:
    """As :func:`tokens_alnum`, with figures such as 1,240 and 2.40 in one piece."""
    return F.regexp_extract_all(F.lower(column(text)), F.lit(NUMERIC), F.lit(0))


def plural_fold(token: Column) -> Column:
    """Drops the s of words of over three characters that don't end in ss."""
    return F.when((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def tokens_numeric(text: Column | str) -> Column:
    return F.transform(raw_numeric(text), plural_fold)


def content_tokens(text: Column | str) -> Column:
    """Distinct folded tokens without stopwords; a stopword is recognised before folding."""
    kept = F.filter(raw_numeric(text), lambda t: ~t.isin(*STOPWORDS))
    return F.array_distinct(F.transform(kept, plural_fold))


def bigrams(text: Column | str) -> Column:
    """Distinct pairs of neighbouring tokens."""
    t = tokens_alnum(text)
    n = F.size(t)
    pairs = F.zip_with(F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def set_overlap(a: Column, b: Column) -> Column:
    """Share of the first set that the second holds; 0 if the first is empty."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def bigram_match(gold: Column, context: Column) -> Column:
    """Shared bigrams by those of the smaller side, which counts as eight at least; of two bigram sets."""
    smaller = F.greatest(F.least(F.size(gold), F.size(context)), F.lit(MIN_BIGRAMS))
    return F.when((F.size(gold) == 0) | (F.size(context) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(gold, context)) / smaller)


def text_match(gold: Column | str, context: Column | str) -> Column:
    return bigram_match(bigrams(gold), bigrams(context))


def normalize_answer(text: Column | str) -> Column:
    """Lower case, single spaces, no punctuation at the ends."""
    spaced = F.trim(F.regexp_replace(F.lower(column(text)), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(spaced, "^[ .,;:!?\"']+", ""), "[ .,;:!?\"']+$", "")


def relative_time(text: Column | str) -> Column:
    """The first expression of relative time, or null."""
    found = F.regexp_extract(column(text), "(?iU)" + RELATIVE_TIME, 1)
    return F.when(found != "", found)


def is_usable_fact(fact: Column | str, answer: Column | str) -> Column:
    """A statement of three words at least that holds its answer between token bounds and is not the answer."""
    f, a = normalize_answer(fact), normalize_answer(answer)
    bounded = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(a, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9])"))
    return F.coalesce((a != "") & (F.size(F.split(f, " ")) >= MIN_FACT_WORDS) & (f != a) & F.rlike(f, bounded), F.lit(False))


# Scripts that are told apart, as Java names them.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Devanagari", "Thai")


def scripts(text: Column | str) -> Column:
    """Writing systems of the letters in the text."""
    return F.filter(F.array(*[F.when(F.regexp_like(column(text), F.lit(rf"(?s).*\p{{Is{s}}}.*")), F.lit(s)) for s in SCRIPTS]), lambda x: x.isNotNull())


def question_problem(question: Column | str, source: Column | str) -> Column:
    """Why a question can't be asked as it is, or null."""
    q = column(question)
    return (
        F.when(F.trim(q, F.lit(" \t\r\n")).contains("\n"), "several_lines")
        .when(F.regexp_like(q, F.lit("(?iU)" + PASSAGE_REFERENCE)), "refers_to_passage")
        .when(F.size(F.array_except(scripts(q), scripts(source))) > 0, "foreign_script")
    )


def sentences(text: Column | str) -> Column:
    """Sentences of the text without blank and heading lines."""
    # Not F.trim itself: transform would hand the line's place to its second parameter, the characters to trim.
    lines = F.filter(F.transform(F.split(column(text), "\n"), lambda line: F.trim(line)), lambda line: (line != "") & ~line.startswith("#"))
    return F.filter(F.split(F.array_join(lines, " "), r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"), lambda s: s != "")


def contains_normalized(text: Column | str, part: Column | str) -> Column:
    """Whether the tokens of ``part`` occur in ``text`` in a row."""
    padded = lambda c: F.concat(F.lit(" "), F.array_join(tokens_numeric(c), " "), F.lit(" "))
    return (F.size(tokens_numeric(part)) > 0) & padded(text).contains(padded(part))


# Months, units of numbers, and the shapes of dates, times, numbers and names.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
UNITS = (
    "percent|business days|calendar days|days?|hours?|minutes?|weeks?|months?|years?|seconds?|"
    "kilometres|kilometers|metres|meters|centimetres|km/h|kWh|km|kg|euros?|dollars?|"
    "people|passengers|stops|trams|buses|vehicles|technicians|controllers|drivers|employees|staff|"
    "members|units|seats|routes|lines|boardings|trips"
)
DATE = rf"\b(?:(?:{MONTHS})\s+\d{{1,2}},\s*\d{{4}}|(?:{MONTHS})\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})\b"
TIME = r"(?<![\d:])\d{1,2}:\d{2}(?![\d:])"
NUMBER = rf"(?:[$€£]\s?)?\d+(?:,\d{{3}})*(?:\.\d+)?(?:\s(?:million|billion))?(?:\s?%|\s(?:{UNITS})\b)?(?![\d,.]\d)"
NAME = r"\b[A-Z][a-zA-Z0-9&'-]*(?:\s+(?:of\s+|the\s+)?[A-Z0-9][a-zA-Z0-9&'-]*)*"


def answer_span(text: Column | str) -> Column:
    """A short answer: the first date, else the first time, else the first number with its unit that belongs to no name, else the last name.

    A number right after a word that begins with a capital is part of a name. A name at the very
    start, or one that ends in 's, is none. Null if there is nothing of the kind.
    """
    t = column(text)
    first = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 0), F.lit(""))
    # The word before a number is taken along, so that one of a name can be told.
    numbers = F.regexp_extract_all(t, F.lit(rf"(\S*\s*)(?<![A-Za-z0-9.,-])({NUMBER})"), F.lit(0))
    free = F.filter(numbers, lambda n: ~F.regexp_like(n, F.lit(rf"^\p{{Lu}}\S*\s+(?:{NUMBER})$")))
    number = F.trim(F.regexp_extract(F.try_element_at(free, F.lit(1)), rf"(?<![A-Za-z0-9.,-])({NUMBER})$", 1))
    names = F.regexp_extract_all(t, F.lit(NAME), F.lit(0))
    names = F.when(F.regexp_like(t, F.lit("^" + NAME)), F.slice(names, 2, 1 << 20)).otherwise(names)
    names = F.filter(names, lambda n: ~n.endswith("'s"))
    return F.coalesce(first(DATE), first(TIME), F.nullif(number, F.lit("")), F.try_element_at(names, F.lit(-1)))


EXCERPT = 700
MOST_MARKED = 80


def excerpt(text: Column | str, answer: Column | str, width: int = EXCERPT) -> Column:
    """The text, white space folded; of a long one a window that begins a third of its width before the answer.

    Without the answer in it, the window is the start. Dots stand where text is left out.
    """
    t, a = F.trim(F.regexp_replace(column(text), r"\s+", " ")), F.coalesce(column(answer), F.lit(""))
    at = F.when(a == "", 0).otherwise(F.instr(F.lower(t), F.lower(a)))
    start = F.when(at == 0, 0).otherwise(F.greatest(F.lit(0), at - 1 - F.lit(width // 3)))
    piece = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(t, start + 1, F.lit(width)), F.when(start + width < F.length(t), "…").otherwise(""))
    return F.when(F.length(t) <= width, t).otherwise(piece)


def escape_html(text: Column | str) -> Column:
    out = F.replace(column(text), F.lit("&"), F.lit("&amp;"))
    for plain, escaped in (("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def highlight(text: Column | str, answer: Column | str) -> Column:
    """The excerpt as HTML with every occurrence of the answer, in any case, in bold; a long answer is not marked."""
    safe = escape_html(excerpt(text, answer))
    needle = escape_html(F.trim(F.coalesce(column(answer), F.lit("")), F.lit(" \t\r\n")))
    quoted = F.concat(F.lit("(?iu)\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    marked = F.regexp_replace(safe, quoted, F.lit("<b>$0</b>"))
    return F.when((needle == "") | (F.length(needle) > MOST_MARKED), safe).otherwise(marked)


UNKNOWN = "I don't know."


def best_sentence(contexts: Column | str, question: Column | str) -> Column:
    """The sentence of the contexts that shares most content words with the question, the first on ties; else that it isn't known."""
    asked = content_tokens(question)
    every = F.flatten(F.transform(column(contexts), sentences))
    scored = F.transform(every, lambda s, i: F.struct(F.size(F.array_intersect(asked, content_tokens(s))).alias("shared"), (-i).alias("place"), s.alias("sentence")))
    best = F.array_max(F.filter(scored, lambda x: x["shared"] > 0))
    return F.coalesce(best["sentence"], F.lit(UNKNOWN))


def lead_sentence(contexts: Column | str) -> Column:
    """The first sentence of the first context; else that it isn't known."""
    return F.coalesce(F.try_element_at(sentences(F.try_element_at(column(contexts), F.lit(1))), F.lit(1)), F.lit(UNKNOWN))


def name_tokens(text: Column | str) -> Column:
    """Tokens of names: capitalised inside a sentence and nowhere written in lower case.

    The start of a sentence, heading, list item or paragraph doesn't count. Lines are folded
    over with the state "a sentence starts here", which a wrapped line inherits.
    """
    lines = F.transform(F.split(column(text), r"\r\n|\r|\n"), lambda line: F.trim(line, F.lit(" \t\f\v")))
    mark = "\ue000"
    # A word at a sentence start gets a mark: of a line after a blank, heading or item, and after . ! ? : ;
    item = r"^([-*+>]|\d+[.)])\s+"
    shaped = F.transform(
        lines,
        lambda line: F.when((line == "") | line.startswith("#"), F.lit(mark)).when(F.regexp_like(line, F.lit(item + ".*")), F.concat(F.lit(mark), F.regexp_replace(line, item, ""))).otherwise(line),
    )
    joined = F.concat(F.lit(mark + " "), F.array_join(shaped, " "))
    ended = F.regexp_replace(joined, r"([A-Za-z0-9])([.!?:;]['\")\]]*) ", "$1$2 " + mark)
    flagged = F.regexp_extract_all(ended, F.lit(mark + r"?\s*[^A-Za-z0-9" + mark + r"]*[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"), F.lit(0))
    word = lambda w: F.regexp_extract(w, r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*$", 0)
    upper = F.filter(flagged, lambda w: ~w.contains(mark) & F.regexp_like(word(w), F.lit("^[A-Z].*")))
    lower = F.filter(flagged, lambda w: F.regexp_like(word(w), F.lit("(?=.*[a-z])^[^A-Z]*$")))
    tokens = lambda ws: F.array_distinct(F.flatten(F.transform(ws, lambda w: tokens_numeric(word(w)))))
    return F.array_except(tokens(upper), tokens(lower))


def lexical_overlap(question: Column | str, source: Column | str) -> Column:
    """Share of a question's content words, names of the source aside, that the source uses; 0 if none are left."""
    asked = F.array_except(content_tokens(question), name_tokens(source))
    return set_overlap(asked, content_tokens(source))


def parse_timestamp(text: Column | str) -> Column:
    """ISO dates and date-times as UTC instants; null if malformed. Needs a UTC session."""
    return F.try_to_timestamp(column(text))
