"""Filters that turn a raw response into an answer.

Each ``*_text`` function maps one response. Filters over all the responses of a document are built
from them in :mod:`scorelake.operators.pipelines`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.binding import bound
from scorelake.functions.numbers import BLANKS, strip
from scorelake.functions.strings import replace_first

# The default answer pattern and the answer given when nothing matches.
DEFAULT_PATTERN = r"#### (\-?[0-9\.\,]+)"
NO_ANSWER = "[invalid]"


def drop_leading_blank_text(text: Column) -> Column:
    return F.regexp_replace(text, "^ ", "")


def _nth(found: Column, n: int) -> Column:
    return F.get(found, F.lit(n)) if n >= 0 else F.try_element_at(found, F.lit(n))


def find_nth(text: Column, pattern: str, group_select: int = 0) -> Column:
    """The n-th match: its only group, its first non-empty group, or all of it. Null without a match.
    The first match is looked up without collecting the others."""
    groups = re.compile(pattern).groups
    if groups <= 1:
        if group_select == 0:
            return strip(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, groups)))
        return strip(_nth(F.regexp_extract_all(text, F.lit(pattern), groups), group_select))
    if group_select == 0:
        picks = [F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in range(1, groups + 1)]
        return strip(F.coalesce(*picks))
    picks = [
        F.nullif(_nth(F.regexp_extract_all(text, F.lit(pattern), g), group_select), F.lit(""))
        for g in range(1, groups + 1)
    ]
    return strip(F.coalesce(*picks))


def regex_text(
    text: Column, pattern: str = DEFAULT_PATTERN, group_select: int = 0, fallback: str = NO_ANSWER
) -> Column:
    return F.coalesce(find_nth(text, pattern, group_select), F.lit(fallback))


def _loosened(
    text: Column, ignore_case: bool, ignore_punctuation: bool, regexes_to_ignore: list[str] | None
) -> Column:
    for pattern in regexes_to_ignore or []:
        text = F.regexp_replace(text, pattern, "")
    if ignore_case:
        text = F.lower(text)
    if ignore_punctuation:
        text = F.regexp_replace(text, r"\p{P}", "")
    return text


def _any_of(words: Column) -> Column:
    """Pattern that matches any of the words literally, earlier words first."""
    quoted = F.transform(
        words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
    )
    return F.array_join(quoted, "|")


def _letter_of(word: Column, words: Column) -> Column:
    """Letter of the last equal word; null when the word is not listed."""
    position = F.size(words) + 1 - F.array_position(F.reverse(words), word)
    return F.when(F.array_contains(words, word), F.char(F.lit(64) + position))


def multi_choice_text(
    text: Column,
    choices: Column,
    pattern: str = DEFAULT_PATTERN,
    group_select: int = 0,
    fallback: str = NO_ANSWER,
    ignore_case: bool = False,
    ignore_punctuation: bool = False,
    regexes_to_ignore: list[str] | None = None,
) -> Column:
    """A choice as ``(A)``: by the main pattern, else by the text of a choice, else by ``: A``."""
    loosen = (ignore_case, ignore_punctuation, regexes_to_ignore)
    options = F.transform(choices, lambda c: _loosened(strip(c), *loosen))
    main = F.nullif(find_nth(text, pattern, group_select), F.lit(""))
    named = strip(
        _nth(F.regexp_extract_all(_loosened(text, *loosen), _any_of(options), F.lit(0)), group_select)
    )
    letter = _letter_of(named, options)
    by_text = F.when(named != "", F.coalesce(F.concat(F.lit("("), letter, F.lit(")")), named))
    letters = F.transform(choices, lambda _, i: F.char(F.lit(65) + i))
    marker = F.concat(F.lit(r":[\s]*("), F.array_join(letters, "|"), F.lit(")"))
    by_letter = _nth(F.regexp_extract_all(text, marker, F.lit(1)), group_select)
    return F.coalesce(
        main, by_text, F.concat(F.lit("("), F.nullif(by_letter, F.lit("")), F.lit(")")), F.lit(fallback)
    )


def question_options(question: Column) -> Column:
    """Texts of the options printed in a question as ``A. text`` lines."""
    found = F.regexp_extract_all(question, F.lit(rf"\b([A-Z])\.{BLANKS}([^\n]*)"), 2)
    return F.transform(found, strip)


def simple_choice_text(text: Column, question: Column) -> Column:
    """Letter (by position) of the option found in the cleaned response, else the cleaned response."""
    cleaned = strip(F.regexp_replace(text, r"(?U)[^\w\s]", ""))
    options = question_options(question)
    named = _nth(F.regexp_extract_all(cleaned, _any_of(options), F.lit(0)), 0)
    return F.coalesce(_letter_of(named, options), cleaned)


def reasoning_answer_text(text: Column) -> Column:
    """What stands in ``<answer>`` tags, else in ``\\boxed{}``, else the whole text."""
    tagged = r"(?s)<answer>\s*(.*?)\s*</answer>"
    boxed = r"(?s)\\boxed\{\s*(.*?)\s*\}"
    return (
        F.when(text.rlike(tagged), F.regexp_extract(text, tagged, 1))
        .when(text.rlike(boxed), F.regexp_extract(text, boxed, 1))
        .otherwise(text)
    )


# Word tables and punctuation of the VQA answer normaliser.
NUMBER_WORDS = {
    "none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
}
ARTICLES = ("a", "an", "the")
PUNCTUATION = (
    ";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",",
    "?", "!",
)
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've",
    "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've",
    "didnt": "didn't", "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't",
    "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't",
    "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd",
    "howll": "how'll", "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm",
    "Ive": "I've", "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've",
    "itll": "it'll", "let's": "let's", "maam": "ma'am", "mightnt": "mightn't",
    "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've",
    "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't", "notve": "not've",
    "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at", "'ows'at": "'ow's'at",
    "'ow'sat": "'ow's'at", "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've",
    "she's": "she's", "shouldve": "should've", "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd",
    "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've", "somebodyll": "somebody'll",
    "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've",
    "someone'dve": "someone'd've", "someonell": "someone'll", "someones": "someone's",
    "somethingd": "something'd", "somethingd've": "something'd've",
    "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's",
    "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've",
    "therere": "there're", "theres": "there's", "theyd": "they'd", "theyd've": "they'd've",
    "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've",
    "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've",
    "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're",
    "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd",
    "wheres": "where's", "whereve": "where've", "whod": "who'd", "whod've": "who'd've",
    "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've",
    "whyll": "why'll", "whyre": "why're", "whys": "why's", "wont": "won't",
    "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've",
    "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll",
    "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've",
    "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll",
    "youre": "you're", "youve": "you've",
}
# Fixed value: periods beyond this many stay, because the flag 32 lands in the count argument.
MAX_PERIODS = 32


def _looked_up(word: Column, table: dict[str, str]) -> Column:
    """The table's entry for a word, else the word. Membership is a hash test; only hits search the map."""
    cells = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(word.isin(*table), F.element_at(cells, word)).otherwise(word)


def strip_punctuation_text(text: Column) -> Column:
    """Punctuation goes away where any of it touches a blank (or the text holds a digit,digit comma);
    elsewhere it turns into a blank. Then periods not followed by a digit go."""
    def marked(t: Column) -> Column:
        return F.struct(t.alias("text"), t.rlike(r"\d,+\d").alias("grouped"))

    def cleaned(m: Column) -> Column:
        out = m["text"]
        for mark in PUNCTUATION:
            touching = F.contains(m["text"], F.lit(mark + " ")) | F.contains(m["text"], F.lit(" " + mark))
            put = F.when(touching | m["grouped"], F.lit("")).otherwise(F.lit(" "))
            out = F.replace(out, F.lit(mark), put)
        return out

    return replace_first(bound(bound(text, marked), cleaned), r"\.(?!\d)", "", MAX_PERIODS)


def plain_words_text(text: Column) -> Column:
    """Number words to digits, articles dropped, contractions restored, single blanks."""
    words = F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")
    words = F.transform(words, lambda w: _looked_up(w, NUMBER_WORDS))
    words = F.filter(words, lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(words, lambda w: _looked_up(w, CONTRACTIONS)), " ")


def vqa_answer_text(text: Column) -> Column:
    out = F.lower(text)
    for find, put in ((",", ""), ("?", ""), ("'s", " 's")):
        out = F.replace(out, F.lit(find), F.lit(put))
    out = strip(F.translate(strip(out), "\n\t", "  "))
    return plain_words_text(strip_punctuation_text(out))
