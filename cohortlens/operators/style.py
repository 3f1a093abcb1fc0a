"""Style features of texts: a declared inventory, found in one pass a text by one automaton.

A feature is a list of words, phrases and word endings (of the text's words in lower
case), or a pattern over the raw text. Words and endings are literals between or before
spaces, all of which one Aho-Corasick automaton looks for at once, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens

#: name -> words and phrases; "-x" stands for words that end in x (of at least three letters before it), "x-" for words that begin with x.
WORDS: dict[str, str] = {
    "first_person": "i|me|my|mine|myself|we|us|our|ours|ourselves",
    "second_person": "you|your|yours|yourself|yourselves|u|ur",
    "third_person": "he|she|they|him|her|them|his|hers|their|theirs|himself|herself|themselves",
    "pronoun_it": "it|its|itself",
    "demonstrative": "this|that|these|those",
    "indefinite_pronoun": "anybody|anyone|anything|everybody|everyone|everything|nobody|none|nothing|nowhere|somebody|someone|something",
    "definite_article": "the",
    "indefinite_article": "a|an",
    "quantifier": "some|any|all|each|every|many|much|few|several|most|both",
    "universal": "always|never|everywhere|every time|all the time",
    "coordinator_and": "and",
    "coordinator_but": "but|yet",
    "coordinator_or": "or|nor",
    "causal": "because|since|therefore|thus|hence|so that|due to",
    "conditional": "if|unless|provided that|as long as|otherwise",
    "concessive": "although|though|even though|however|nevertheless|despite|in spite of",
    "temporal": "when|while|before|after|until|as soon as|once",
    "place": "here|there|above|below|behind|inside|outside|nearby|away",
    "time_adverb": "now|then|today|yesterday|tomorrow|soon|later|recently|already",
    "wh_word": "who|whom|whose|which|what|where|why|how",
    "negation": "not|no|never|cannot",
    "negative_contraction": "don't|doesn't|didn't|isn't|aren't|wasn't|weren't|won't|wouldn't|can't|couldn't|shouldn't|haven't|hasn't|hadn't",
    "contraction": "i'm|i've|i'd|i'll|you're|you've|he's|she's|it's|we're|we've|they're|they've|that's|there's|what's|let's",
    "possibility_modal": "can|may|might|could",
    "necessity_modal": "ought|should|must|have to|need to",
    "prediction_modal": "will|would|shall|going to|gonna",
    "be": "am|is|are|was|were|be|been|being",
    "have": "have|has|had|having",
    "do": "do|does|did|doing|done",
    "private_verb": "think|thought|believe|feel|felt|know|knew|understand|wonder|remember|realize|guess|hope|doubt",
    "public_verb": "say|said|says|tell|told|claim|admit|explain|report|suggest|state|reply",
    "suasive_verb": "ask|demand|insist|propose|recommend|require|request|urge|advise",
    "perception_verb": "see|saw|seen|hear|heard|look|watch|notice|smell|taste",
    "want_need": "want|wants|wanted|need|needs|needed|wish",
    "seem_appear": "seem|seems|seemed|appear|appears|appeared",
    "try": "try|tries|tried|trying|attempt",
    "get": "get|gets|got|gotten|getting",
    "amplifier": "very|really|extremely|absolutely|completely|totally|so much|highly|super",
    "downtoner": "almost|barely|hardly|merely|nearly|only|slightly|somewhat|just",
    "hedge": "maybe|perhaps|probably|possibly|kind of|sort of|i guess|more or less|at about",
    "emphatic": "indeed|in fact|of course|for sure|definitely|certainly|no doubt",
    "comparison": "than|more|less|better|worse|as well as|like",
    "superlative": "best|worst|least|most of",
    "conjunct": "moreover|furthermore|additionally|in addition|in conclusion|for example|for instance|in particular|on the other hand",
    "discourse_particle": "well|anyway|anyways|okay|ok|oh|hey|yeah|yep|nope|lol",
    "politeness": "please|thanks|thank you|sorry|excuse me|appreciate|grateful",
    "greeting": "hi|hello|dear|good morning|good evening",
    "request_form": "can you|could you|would you|help me|tell me|show me|give me|explain to me",
    "question_form": "what is|how do|how to|how can|is there|are there|do you|does anyone",
    "preposition_of": "of",
    "preposition_in": "in|into|inside of|within",
    "preposition_to": "to|toward|towards",
    "preposition_with": "with|without",
    "preposition_on": "on|upon|onto",
    "preposition_for": "for",
    "preposition_from": "from|by|through",
    "split_infinitive": "to really|to just|to only|to actually|to fully|to simply",
    "existential": "there is|there are|there was|there were",
    "passive": "is being|was being|been made|was made|is known|was given|are given|is called",
    "perfect": "have been|has been|had been|have had|has had",
    "that_clause": "say that|said that|think that|know that|believe that|so that",
    "nominalization": "-tion|-ment|-ness|-ity",
    "agent_noun": "-er|-or|-ist",
    "gerund": "-ing",
    "past_form": "-ed",
    "adverb_ly": "-ly",
    "adjective_ous": "-ous|-ful|-less|-able|-ible|-ive",
    "abstract_noun": "-ance|-ence|-ship|-hood|-dom|-ism",
    "verb_ize": "-ize|-ise|-ify",
    "possessive": "-'s",
    "negative_prefix": "un-|non-|dis-",
    "again_prefix": "re-",
    "slang": "gonna|wanna|gotta|kinda|sorta|dunno|ain't|y'all|bro|dude",
    "emotion_good": "good|great|happy|love|nice|awesome|amazing|glad|enjoy",
    "emotion_bad": "bad|sad|hate|angry|terrible|awful|afraid|worried|hurt",
    "kinship": "mom|dad|mother|father|brother|sister|son|daughter|wife|husband|family",
    "body": "head|hand|hands|face|eye|eyes|heart|body|hair|skin",
    "money": "money|price|cost|pay|buy|cheap|expensive|dollars",
    "number_word": "one|two|three|four|five|ten|hundred|thousand|million",
}
#: name -> pattern over the raw text, in the common part of the dialects.
PATTERNS: dict[str, str] = {
    "question_mark": r"\?", "exclamation": "!", "ellipsis": r"\.\.\.|…", "digit": "[0-9]", "capitals": "(?:^|[^A-Za-z])[A-Z]{2,}(?:[^A-Za-z]|$)", "url": "https?://", "mention_or_mail": "@",
    "hashtag_or_heading": "#", "quotation": "[\"“”«»]", "bracket": r"[()\[\]]", "dash": "[–—]|--", "semicolon": ";", "colon": ":", "list_line": r"(?:^|\n)[ ]*[-*•] ", "new_line": "\\n",
    "letter_beyond_ascii": "[À-ÿ]", "symbol": "[$%&*|<>=+]", "repeated_mark": r"[!?]{2,}",
}
NAMES = (*WORDS, *PATTERNS)


def literals(words: str) -> list[str]:
    """What to look for in the words of a text between spaces."""
    out = []
    for w in words.split("|"):
        out.append(f"{w[1:]} " if w[0] == "-" else f" {w[:-1]}" if w[-1] == "-" else f" {w} ")
    return out


def spaced_words(text: Column) -> Column:
    """The words of a text in lower case between single spaces, one before the first and one behind the last."""
    return F.concat(F.lit(" "), F.array_join(word_tokens(text), " "), F.lit(" "))


@lru_cache(maxsize=1)
def _automaton():
    """Finds the literals' features; without the library for it, each literal is looked for on its own."""
    found: dict[str, list[int]] = {}
    for i, words in enumerate(WORDS.values()):
        for w in literals(words):
            found.setdefault(w, []).append(i)
    try:
        import ahocorasick
    except ImportError:
        return lambda s: {i for w, many in found.items() if w in s for i in many}
    a = ahocorasick.Automaton()
    for w, many in found.items():
        a.add_word(w, tuple(many))
    a.make_automaton()

    def search(s: str) -> set[int]:
        out: set[int] = set()
        for _, many in a.iter(s):
            out.update(many)
            if len(out) == len(WORDS):
                break
        return out

    return search


def style_features(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts, without its text, with features (the sorted names of those present) and n_features. Null text: none."""
    keep = [c for c in texts.columns if c != text]
    raw = F.coalesce(F.col(text), F.lit(""))
    marks = F.array_compact(F.array(*(F.when(raw.rlike(p), F.lit(n)) for n, p in PATTERNS.items())))
    rows = texts.select(*keep, spaced_words(F.col(text)).alias("_words"), marks.alias("_marks"))
    names = list(WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _automaton()
        for b in batches:
            found = [[*(names[i] for i in search(w)), *m] for w, m in zip(b.column("_words").to_pylist(), b.column("_marks").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(found, pa.list_(pa.string()))], [*keep, "features"])

    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    out = rows.mapInArrow(run, f"{fields}, features array<string>")
    return out.withColumn("features", F.array_sort("features")).withColumn("n_features", F.size("features").cast("long"))


def prevalence(found: DataFrame, side: str = "cohort") -> DataFrame:
    """(feature, n_target, n_baseline, share_target, share_baseline, log_odds, se, place): every feature of the inventory, by strength.

    The log-odds have half a count added to each cell; a feature that all or no texts have gets zero.
    """
    t = F.col(side) == "target"
    n = found.agg(F.count_if(t).alias("all_t"), F.count_if(~t).alias("all_b"))
    # one row a feature, some hundred at most
    counts = found.select(side, F.explode("features").alias("feature")).groupBy("feature").agg(F.count_if(t).alias("n_target"), F.count_if(~t).alias("n_baseline"))
    every = n.select("all_t", "all_b", F.explode(F.array(*map(F.lit, NAMES))).alias("feature")).join(F.broadcast(counts), "feature", "left").na.fill(0, ["n_target", "n_baseline"])
    a, c = F.col("n_target"), F.col("n_baseline")
    b, d = F.col("all_t") - a, F.col("all_b") - c
    odds = F.when((a + c == 0) | (b + d == 0), 0.0).otherwise(F.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))))
    se = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5))
    share = lambda x, of: x / F.nullif(F.col(of), F.lit(0))
    rows = every.select("feature", "n_target", "n_baseline", share(a, "all_t").alias("share_target"), share(c, "all_b").alias("share_baseline"), odds.alias("log_odds"), se.alias("se"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs(F.round("log_odds", 9))), "feature")).cast("long"))
