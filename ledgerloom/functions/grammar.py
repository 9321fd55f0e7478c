"""Rule-based grammar over arrays of tokens: tokens, parts of speech, lemmas and entities.

All of it is expressions over arrays, so a document's tokens stay in its row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

LETTER = "A-Za-zÀ-ɏ"
EN_TOKEN = rf"([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|[0-9]+(?:[.,][0-9]+)*|n['’]t|['’](?:ve|re|ll|m|d|s)|[{LETTER}]+(?:[-'’][{LETTER}]+)*|[^\s0-9{LETTER}])"
FR_TOKEN = rf"((?:www\.|https?://)\S+|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|[0-9]+(?:[.,][0-9]+)*|[{LETTER}]+['’]|[{LETTER}]+(?:-[{LETTER}]+)*|[^\s0-9{LETTER}])"
AR_TOKEN = r"([؀-ۿ]+|[A-Za-z]+|[0-9]+|[^\s؀-ۿA-Za-z0-9])"
DATE = r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|(?:19|20)[0-9]{2})$"
CURRENCY = r"^(?:€|\$|£|EUR|USD|GBP|MAD|TND|euros?|dollars?|dirhams?|dinars?)$"

EN = {
    "DT": "the a an this that these those every each some any no",
    "IN": "in on at by for with from of to into over under between through during before after about against without",
    "CC": "and or but nor yet so",
    "PRP": "i you he she it we they me him her us them my your his its our their",
    "RB": "not never always very too also often here there now then n't",
    "VB": "be is are was were been am do does did have has had will would can could may might must shall should ca wo 'm 're 've 'll 'd",
}
FR = {
    "DT": "le la les un une des du ce cet cette ces mon ma mes ton ta tes son sa ses notre nos votre vos leur leurs l' d'",
    "IN": "de à en dans par pour sur avec sans sous chez vers entre contre depuis",
    "CC": "et ou mais donc or ni car",
    "PRP": "je tu il elle on nous vous ils elles me te se lui y qui que qu' j' m' t' s' n' c'",
    "RB": "ne pas jamais toujours très trop aussi ici là bien plus",
    "VB": "être est sont était étaient suis es sommes êtes avoir a ont avait avaient ai as avons avez faire fait font va vont peut peuvent doit doivent",
}
AR = {
    "IN": "في من إلى على عن مع بين تحت فوق",
    "CC": "و أو ثم لكن",
    "PRP": "هو هي هم أنا نحن أنت هذا هذه ذلك التي الذي",
    "RB": "لا لم لن قد",
}
EN_IRREGULAR = {form: word for word, forms in {"be": "is are was were been am 'm 're", "have": "has had 've", "do": "does did", "not": "n't", "can": "ca", "will": "wo 'll", "would": "'d", "man": "men", "woman": "women", "child": "children", "go": "went", "say": "said", "make": "made"}.items() for form in forms.split()}
FR_IRREGULAR = {form: word for word, forms in {"être": "est sont était suis", "avoir": "a ont avait ai", "aller": "va vont", "faire": "fait", "le": "les la l'", "de": "d'", "un": "une", "à": "aux", "œil": "yeux", "pouvoir": "peut", "devoir": "doit"}.items() for form in forms.split()}
_AR_MARKS = "[ً-ٰٟـ]"


def _lower(t: Column) -> Column:
    return F.translate(F.lower(t), "’", "'")


def en_tokens(text: Column) -> Column:
    """Words, numbers, dates and marks; contractions are taken apart."""
    t = F.coalesce(text, F.lit(""))
    for _ in range(2):  # twice, for words such as I'd've
        t = F.regexp_replace(t, rf"([{LETTER}])(n['’]t|['’](?:ve|re|ll|m|d|s))([^{LETTER}0-9'’]|$)", "$1 $2$3")
    return F.regexp_extract_all(t, F.lit(EN_TOKEN), F.lit(1))


def fr_tokens(text: Column) -> Column:
    """Words, addresses, numbers, dates and marks; elided words end with their apostrophe, ``aujourd'hui`` stays whole."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("ujourd'hui"), F.lit("ujourdʼhui"))
    found = F.regexp_extract_all(t, F.lit(FR_TOKEN.replace(f"[{LETTER}]+(?:-", f"[{LETTER}ʼ]+(?:-")), F.lit(1))
    return F.transform(found, lambda x: F.translate(x, "ʼ", "'"))


def ar_normal(text: Column) -> Column:
    """Marks off, the forms of alef as one."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), _AR_MARKS, ""), "أإآ", "ااا")


def ar_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), _AR_MARKS, ""), F.lit(AR_TOKEN), F.lit(1))


def ar_segments(token: Column) -> Column:
    """Struct proclitic, stem, enclitic; the stem keeps three letters at least."""
    head = F.regexp_extract(token, "^(وال|بال|كال|فال|لل|ال|[وفبكل])(?=.{3,})", 1)
    rest = F.substr(token, F.length(head) + 1)
    tail = F.regexp_extract(rest, "(?<=.{3})(هما|كما|هم|هن|كم|نا|ها|ه|ك)$", 1)
    return F.struct(head.alias("proclitic"), F.substr(rest, F.lit(1), F.length(rest) - F.length(tail)).alias("stem"), tail.alias("enclitic"))


def _closed(low: Column, classes: dict[str, str]) -> Column:
    """The tag of a word of a closed class, else null."""
    return F.coalesce(*[F.when(low.isin(*words.split()), tag) for tag, words in classes.items()])


def _at(tokens: Column, i: Column) -> Column:
    return F.get(tokens, i)


def pos(tokens: Column, lang: str) -> Column:
    """A tag for each token: PUNCT, CD, the closed classes, then NNP, VB, JJ, RB or NN by form and neighbours."""
    classes = {"en": EN, "fr": FR, "ar": AR}[lang]

    def tag(t: Column, i: Column) -> Column:
        # named inside lambdas, so that a token and the one before are brought to lower case once and not for each rule
        return F.element_at(F.transform(F.array(_lower(t)), lambda low: F.element_at(F.transform(F.array(_lower(_at(tokens, i - 1))), lambda before: of(t, i, low, before)), 1)), 1)

    def of(t: Column, i: Column, low: Column, before: Column) -> Column:
        out = F.when(t.rlike(r"^[0-9]"), "CD").when(~t.rlike(r"[\p{L}0-9]"), "PUNCT")
        if lang == "en":
            subject = before.isin(*"he she it that there what who i you we they".split())
            out = out.when(low == "'s", F.when(subject, "VB").otherwise("POS"))
        if lang == "fr":
            out = out.when((low == "plus") & before.isin("ne", "n'"), "RP")
        return F.coalesce(out, _closed(low, classes), open_class(t, i, low, before))

    def open_class(t: Column, i: Column, low: Column, before: Column) -> Column:
        if lang == "ar":
            return F.when(t.rlike("^ال") | t.rlike("ة$"), "NN").when(t.rlike("^[يت].{3,}"), "VB").otherwise("NN")
        out = F.when(t.rlike("^[A-ZÀ-Þ]") & ((i > 0) & ~F.coalesce(_at(tokens, i - 1).rlike(r"^[.!?]$"), F.lit(False))), "NNP")
        if lang == "en":
            return out.when(low.rlike("ly$"), "RB").when(before.isin("to", "will", "can", "must", "should", "would"), "VB").when(low.rlike("(?:ing|ed|ize|ise|ify|ate)$"), "VB").when(low.rlike("(?:ous|ful|ive|able|ible|less|al|ic)$"), "JJ").otherwise("NN")
        return out.when(low.rlike("ment$"), "RB").when(before.isin("je", "tu", "il", "elle", "on", "nous", "vous", "ils", "elles", "j'"), "VB").when(low.rlike("(?:er|ir|ez|ons|ent)$"), "VB").when(low.rlike("(?:eux|euse|ique|able|ible|if|ive|al|ale)$"), "JJ").otherwise("NN")

    return F.transform(tokens, tag)


def lemma(token: Column, tag: Column, lang: str) -> Column:
    return F.element_at(F.transform(F.array(_lower(token)), lambda low: _lemma(token, low, tag, lang)), 1)


def _lemma(token: Column, low: Column, tag: Column, lang: str) -> Column:
    if lang == "ar":
        return ar_segments(ar_normal(token))["stem"]
    words = EN_IRREGULAR if lang == "en" else FR_IRREGULAR
    known = F.try_element_at(F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.lit(v))]), low)
    cut = lambda n: F.substr(low, F.lit(1), F.length(low) - n)
    if lang == "en":
        stem = F.when(low.rlike("(?:ing|ed)$"), F.regexp_replace(F.regexp_replace(low, "(?:ing|ed)$", ""), r"([bdgmnprt])\1$", "$1"))
        rule = (
            F.when(~tag.isin("NN", "VB"), low).when(low.rlike(".{3,}ies$"), F.concat(cut(3), F.lit("y"))).when(low.rlike("(?:ss|us|is)$"), low)
            .when(low.rlike(".{3,}(?:ing|ed)$") & (tag == "VB"), stem).when(low.rlike("(?:ches|shes|xes|zes|sses)$"), cut(2)).when(low.rlike(".{3,}s$"), cut(1)).otherwise(low)
        )
    else:
        rule = F.when(tag.isin("NN", "JJ") & low.rlike(".{3,}aux$"), F.concat(cut(3), F.lit("al"))).when(tag.isin("NN", "JJ") & low.rlike(".{3,}[sx]$"), cut(1)).when(low.rlike(".{2,}ée?s?$"), F.regexp_replace(low, "ée?s?$", "er")).otherwise(low)
    return F.when(tag == "PUNCT", token).otherwise(F.coalesce(known, rule))


def ner(tokens: Column, tags: Column) -> Column:
    """A label for each token: dates, currencies, and the runs of capitalised words. After a preposition a run is a place, else MISC."""

    def label(t: Column, i: Column) -> Column:
        proper = lambda k: F.coalesce((_at(tags, k) == "NNP") & _at(tokens, k).rlike("^[A-ZÀ-Þ][a-zà-ÿ]+"), F.lit(False))
        kind = F.when(_at(tags, i - 1) == "IN", "LOC").otherwise("MISC")
        return F.when(t.rlike(DATE), "B-DATE").when(t.rlike(CURRENCY), "B-CUR").when(proper(i) & proper(i - 1), "I-").when(proper(i), F.concat(F.lit("B-"), kind)).otherwise("O")

    return carried(F.transform(tokens, label))


def carried(labels: Column) -> Column:
    """``I-`` without a type takes the type of the label that its run begins with; one pass over a string, linear in the tokens."""
    typed = F.concat(F.lit(" "), F.array_join(labels, "  "), F.lit(" "))

    def of(kind: str):
        begins = rf"^ B-{kind} (?: I- )*"
        return lambda run: F.when(run.startswith(f" B-{kind} "), F.concat(F.replace(F.regexp_substr(run, F.lit(begins)), F.lit(" I- "), F.lit(f" I-{kind} ")), F.regexp_replace(run, begins, ""))).otherwise(run)

    for kind in ("LOC", "MISC"):
        typed = F.array_join(F.transform(F.split(typed, f"(?= B-{kind} )"), of(kind)), "")
    return F.filter(F.split(F.trim(typed), " +"), lambda x: x != "")


def bio_repaired(labels: Column) -> Column:
    """``I-x`` after ``O`` or another type becomes ``B-x``."""
    kind = lambda x: F.substr(x, F.lit(3))

    def repaired(known: Column) -> Column:
        orphan = lambda x, i: x.startswith("I-") & ((i == 0) | ~F.coalesce((_at(known, i - 1) != "O") & (kind(_at(known, i - 1)) == kind(x)), F.lit(False)))
        return F.transform(known, lambda x, i: F.when(orphan(x, i), F.concat(F.lit("B-"), kind(x))).otherwise(x))

    # named inside a lambda, so that the labels are made once and not for each of their places
    return F.element_at(F.transform(F.array(labels), repaired), 1)


def entities(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, nth, type, text, first: the spans of repaired labels in rows of tokens (keys, tok_index, token, ner)."""
    order = W.partitionBy(*keys).orderBy("tok_index")
    marked = tokens.filter("ner <> 'O'").withColumn("nth", F.sum(F.col("ner").startswith("B-").cast("int")).over(order)).filter("nth > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_index", "token"))), lambda s: s["token"]), " ")
    return marked.groupBy(*keys, "nth").agg(F.substr(F.min_by("ner", "tok_index"), F.lit(3)).alias("type"), text.alias("text"), F.min("tok_index").alias("first"))


def analysed(text: Column, lang: str, lemmas: bool = True) -> Column:
    """Array of token, lemma, pos, ner of a text in ``lang`` (en, fr or ar); without ``lemmas`` there is none."""
    tokens = {"en": en_tokens, "fr": fr_tokens, "ar": ar_tokens}[lang](text)
    tagged = F.transform(F.array(tokens), lambda t: F.struct(t.alias("t"), pos(t, lang).alias("p")))  # so that the tokens are made once
    rows = F.element_at(F.transform(tagged, lambda s: F.arrays_zip(s["t"].alias("token"), s["p"].alias("pos"), ner(s["t"], s["p"]).alias("ner"))), 1)
    if not lemmas:
        return rows
    return F.transform(rows, lambda x: F.struct(x["token"].alias("token"), lemma(x["token"], x["pos"], lang).alias("lemma"), x["pos"].alias("pos"), x["ner"].alias("ner")))


def grammar_tokens(chunks: DataFrame, lang: Column) -> DataFrame:
    """The columns of ``chunks`` but text, with lang, tok_index, token, lemma, pos, ner: a row a token. Languages other than fr and ar are read as English."""
    rows = F.when(lang == "fr", analysed(F.col("text"), "fr")).when(lang == "ar", analysed(F.col("text"), "ar")).otherwise(analysed(F.col("text"), "en"))
    kept = [c for c in chunks.columns if c not in ("text", "lang")]
    return chunks.select(*kept, lang.alias("lang"), F.posexplode(rows).alias("tok_index", "__t")).select(*kept, "lang", "tok_index", "__t.*")


def is_semantic(tag: Column, label: Column) -> Column:
    """Nouns, names, adjectives and verbs carry meaning; other words only if they are part of an entity."""
    return tag.isin("NN", "NNP", "JJ", "VB") | (~tag.isin("PUNCT", "DT", "IN", "CC", "PRP", "CD", "RB", "RP", "POS") & (label != "O"))


#: The tags that a tag of the Penn set is read as; every other one counts as a noun.
SIMPLE_TAGS = {
    **{t: "NN" for t in ("NN", "NNS")}, **{t: "NNP" for t in ("NNP", "NNPS")}, **{t: "VB" for t in ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "MD")}, **{t: "JJ" for t in ("JJ", "JJR", "JJS")},
    **{t: "RB" for t in ("RB", "RBR", "RBS", "WRB")}, **{t: "PRP" for t in ("PRP", "PRP$", "WP", "WP$", "EX")}, **{t: "DT" for t in ("DT", "PDT", "WDT")},
    "IN": "IN", "TO": "TO", "CC": "CC", "CD": "CD", "RP": "RP", "POS": "POS", "UH": "UH", "FW": "FW", "SYM": "SYM", **{t: "PUNCT" for t in (".", ",", ":", "``", "''", "(", ")", "-LRB-", "-RRB-", "#", "$")},
}


def simple_tag(tag: Column) -> Column:
    """A Penn part of speech in the short set of tags."""
    known = F.create_map(*[x for t, s in SIMPLE_TAGS.items() for x in (F.lit(t), F.lit(s))])
    return F.coalesce(F.try_element_at(known, F.coalesce(F.upper(F.trim(tag)), F.lit(""))), F.lit("NN"))


#: Whose spans go first where they overlap.
SPAN_ORDER = ("model", "date", "currency")


def labels_of_spans(tokens: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tok_index, ner: B- and I- labels of the tokens (keys, tok_index, start, end) that the characters of a span (keys, start, end, label, source) touch.

    Spans go by source in the order of ``SPAN_ORDER``, then by their place; one that touches a token already labelled is dropped whole. Tokens and spans of one
    sentence, by ``keys``, come together, nothing larger.
    """
    words = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tok_index", "start", "end"))).alias("__t"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SPAN_ORDER]), F.col("source")).cast("int"), F.lit(0)), F.lit(len(SPAN_ORDER) + 1))
    found = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "label"))).alias("__s"))
    both = words.join(found, keys, "left")

    def add(labels: Column, span: Column) -> Column:
        touches = lambda t: ~((t["end"] <= span["start"]) | (t["start"] >= span["end"]))
        free = ~F.exists(F.arrays_zip(F.col("__t").alias("t"), labels.alias("l")), lambda x: touches(x["t"]) & (x["l"] != "O"))
        begins = F.get(F.filter("__t", touches), 0)["tok_index"]
        new = F.zip_with("__t", labels, lambda t, old: F.when(touches(t), F.concat(F.when(t["tok_index"] == begins, "B-").otherwise("I-"), span["label"])).otherwise(old))
        return F.when(free, new).otherwise(labels)

    labels = F.aggregate(F.coalesce("__s", F.array().cast("array<struct<rank:int,start:int,end:int,label:string>>")), F.transform("__t", lambda _: F.lit("O")), add)
    return both.select(*keys, F.explode(F.arrays_zip(F.transform("__t", lambda t: t["tok_index"]).alias("tok_index"), labels.alias("ner"))).alias("__z")).select(*keys, "__z.*")
