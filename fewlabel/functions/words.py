"""Word tables. Every function that uses one also takes the caller's own list."""

from __future__ import annotations

# Vocabularies behind the share and presence features.
SECOND_PERSON = ("you", "your", "yours", "yourself", "yourselves", "u")
FIRST_PERSON = ("i", "me", "my", "mine", "we", "us", "our", "ours")
NEGATIONS = (
    "no", "not", "never", "none", "nothing", "nobody", "nowhere", "neither", "nor", "without",
    "can't", "won't", "don't", "doesn't", "isn't", "aren't",
)
DEMONSTRATIVES = ("this", "that", "these", "those")
SUPERLATIVES = (
    "best", "worst", "most", "least", "biggest", "smallest", "greatest", "largest", "easiest", "hardest",
)
CURIOSITY = (
    "why", "how", "what", "this", "these", "that", "reason", "reasons", "secret", "secrets",
    "happens", "happened", "happen", "thing", "things",
)
URGENCY = ("now", "today", "before", "after", "soon", "urgent", "immediately", "finally")
SURPRISE = (
    "surprising", "shocking", "unbelievable", "amazing", "weird", "secret", "truth", "actually", "really",
)

VOCABULARIES = {
    "second_person": SECOND_PERSON,
    "first_person": FIRST_PERSON,
    "negation": NEGATIONS,
    "demonstrative": DEMONSTRATIVES,
    "superlative": SUPERLATIVES,
    "curiosity": CURIOSITY,
    "urgency": URGENCY,
    "surprise": SURPRISE,
}

# Our own choices: the source of these lists is not public, so they are
# defaults the caller may replace.
QUESTION_STARTERS = (
    "who", "what", "when", "where", "why", "how", "which", "whose", "is", "are", "was", "were",
    "do", "does", "did", "can", "could", "should", "would", "will",
)
NUMBER_WORDS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven",
    "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million", "billion",
)
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any",
    "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both",
    "but", "by", "can", "could", "did", "do", "does", "down", "during", "each", "few", "for",
    "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers", "him", "his",
    "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most", "my", "no",
    "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "out",
    "over", "own", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their",
    "theirs", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too",
    "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while",
    "who", "whom", "why", "will", "with", "would", "you", "your", "yours",
)
DEFAULT_LEXICON = (
    ("good", 1.9), ("great", 3.1), ("excellent", 2.7), ("best", 3.2), ("love", 3.2), ("happy", 2.7),
    ("win", 2.8), ("hope", 1.9), ("nice", 1.8), ("beautiful", 2.9), ("amazing", 2.8), ("fresh", 1.3),
    ("bad", -2.5), ("worst", -3.1), ("terrible", -2.1), ("hate", -2.7), ("sad", -2.1), ("lose", -1.6),
    ("fear", -2.2), ("wrong", -2.1), ("poor", -2.1), ("ugly", -2.3), ("awful", -2.0), ("harsh", -1.9),
)
