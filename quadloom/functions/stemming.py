"""English stems in five steps, each under a condition on the measure of what is left (M. F. Porter, 1980)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A consonant and a vowel, once a y that is a consonant has been written as Y.
C, V = "[^aeiouy]", "[aeiouy]"
#: Beginnings of a stem whose measure, the number of vowels followed by consonants, is above zero or one.
ONE, TWO = f"{C}*{V}+{C}", f"{C}*{V}+{C}+{V}+{C}"
#: A consonant, a vowel and a last consonant that is not w, x or y.
CVC = f"{C}{V}[^aeiouywxY]"
#: The rules of the method, as pattern and replacement. A bar marks an ending that step 1 took off.
RULES = (
    # a y is a consonant at the start and behind a vowel
    ("(^|[aeiou]|(?<=[^aeiouy])y)y", "$1Y"),
    # step 1: plurals and participles
    ("(?<=ss|i)es$", ""),
    ("(?<!s)s$", ""),
    (f"^({ONE}.*)eed$", "$1ee"),
    (f"^({C}*{V}.*)(?:(?<!e)ed|ing)$", "$1|"),
    (r"(at|bl|iz)\|$", "$1e"),
    (r"([^aeioulszy])\1\|$", "$1"),
    (rf"^({C}*{CVC})\|$", "$1e"),
    (r"\|$", ""),
    (f"^({C}*{V}.*)[yY]$", "$1i"),
    # step 2: double endings, in the order of what stays
    (f"^({ONE}.*(?:at(?=ional$|or$)|(?<!iz)at(?=ion$)|iz(?=ation$|er$)|[ea]nc(?=i$)|abl(?=i$)|iv(?=iti$)))[a-z]+$", "$1e"),
    (f"^({ONE}.*(?:(?<!a)tion(?=al$)|al(?=li$|ism$|iti$)|ent(?=li$)|e(?=li$)|ous(?=li$|ness$)|ive(?=ness$)|ful(?=ness$)))[a-z]+$", "$1"),
    (f"^({ONE}.*)biliti$", "$1ble"),
    # step 3
    (f"^({ONE}.*(?:ic(?=ate$|iti$|al$)|al(?=ize$)))[a-z]+$", "$1"),
    (f"^({ONE}.*)(?:ative|ful|ness)$", "$1"),
    # step 4: what is left of an ending behind a stem of measure above one
    (f"^({TWO}.*)(?:al|ance|ence|er|ic|able|ible|ant|ement|(?<!e)ment|(?<!m)ent|(?<=[st])ion|ou|ism|ate|iti|ous|ive|ize)$", "$1"),
    # step 5: a last e, a double l
    (f"^({TWO}.*|{C}*{V}+{C}+{V}*(?<!{CVC}))e$", "$1"),
    (f"^(?={TWO})(.*l)l$", "$1"),
)
#: Words that end otherwise are their own stems; this spares them the rules.
ENDS = "(?:[seyi]|ed|ing|al|ful|ll|[eo]r|ic|[ae]nt|ion|ism|ou)$"


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters are their own. Letters outside a-z count as consonants."""
    out = word
    for pattern, replacement in RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.when((F.length(word) <= 2) | ~word.rlike(ENDS), word).otherwise(F.translate(out, "Y", "y"))
