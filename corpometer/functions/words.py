"""Fixed word lists and tables used by the text functions."""

from __future__ import annotations

import unicodedata

# English stop words of the usual natural-language toolkit list.
ENGLISH_STOP_WORDS: tuple[str, ...] = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
    yourselves he him his himself she she's her hers herself it it's its itself they them their
    theirs themselves what which who whom this that that'll these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at
    by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don
    don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
    doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
    needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)

# The news topics articles are generated for, as "Section - Subsection".
NEWS_TOPICS: tuple[str, ...] = (
    "US - Crime + Justice",
    "World - Africa",
    "World - Americas",
    "World - Asia",
    "World - Australia",
    "World - China",
    "World - Europe",
    "World - India",
    "World - Middle East",
    "World - United Kingdom",
    "Politics - CNN Polls",
    "Politics - Elections",
    "Business - Tech",
    "Business - Media",
    "Business - Markets",
    "Business - Pre-markets",
    "Business - After-Hours",
    "Business - Investing",
    "Business - Markets Now",
    "Health - Fitness",
    "Health - Food",
    "Health - Sleep",
    "Health - Mindfulness",
    "Health - Relationships",
    "Entertainment - Movies",
    "Entertainment - Television",
    "Entertainment - Celebrity",
    "Tech - Innovate",
    "Tech - Foreseeable Future",
    "Tech - Innovative Cities",
    "Style - Arts",
    "Style - Design",
    "Style - Fashion",
    "Style - Architecture",
    "Style - Luxury",
    "Style - Beauty",
    "Travel - Destinations",
    "Travel - Food & Drink",
    "Travel - Lodging and Hotels",
    "Travel - News",
    "Sports - Pro Football",
    "Sports - College Football",
    "Sports - Basketball",
    "Sports - Baseball",
    "Sports - Soccer",
    "Sports - Olympics",
    "Sports - Hockey",
    "Science - Space",
    "Science - Life",
    "Science - Medicine",
    "Science - Climate",
    "Science - Solutions",
    "Science - Weather",
)

# Topics that one of the topic lists names twice.
DOUBLE_WEIGHT_TOPICS: tuple[str, ...] = (
    "World - India",
    "World - Middle East",
    "World - United Kingdom",
)

# Start of the text stored in place of an article when generation failed.
FAILED_GENERATION_PREFIX = "Error generating article:"

# Chat and end-of-text markers that decoding may leave in generated text.
SPECIAL_TOKENS: tuple[str, ...] = (
    "<bos>",
    "<eos>",
    "<pad>",
    "<s>",
    "</s>",
    "<end_of_turn>",
    "<start_of_turn>",
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<|end|>",
    "<|user|>",
    "<|assistant|>",
)


def accent_table() -> tuple[str, str]:
    """Character pairs for ``translate`` that take accents off, built from Unicode decomposition.

    Every character of the basic plane whose decomposition without combining marks is one other
    character maps to it; the combining marks have no counterpart, so ``translate`` drops them.
    """
    source, target, marks = [], [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if unicodedata.category(char) == "Mn":
            marks.append(char)
            continue
        parts = unicodedata.normalize("NFD", char)
        plain = unicodedata.normalize(
            "NFC", "".join(p for p in parts if unicodedata.category(p) != "Mn")
        )
        if plain != char and len(plain) == 1:
            source.append(char)
            target.append(plain)
    return "".join(source + marks), "".join(target)
