"""Stemming by ordered rules (M3): the published Snowball algorithms of four
languages as a cascade of ``Column`` expressions.

A word's regions (R1, R2, RV) are start positions found by a pattern. A step
takes the longest of its suffixes that the word (or its RV) ends with, and
acts on it if the step's condition holds; later steps see the result. Every
step is a column of its own, computed for distinct words, and stems are joined back
to the features. No Python runs on the executors."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fence
from .dfm import Dfm
from .stem import stem_features

LANGUAGES = ("english", "french", "german", "spanish")

# Vowels, suffix lists and exceptions of the published algorithms.
VOWELS = {"english": "aeiouy", "french": "aeiouyâàëéêèïîôûù", "german": "aeiouyäöü", "spanish": "aeiouáéíóúü"}
ENGLISH_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
ENGLISH_KEPT = "inning outing canning herring earring proceed exceed succeed".split()
ENGLISH_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful",
    "lessli": "less"}
ENGLISH_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
                 "ful": "", "ness": ""}
ENGLISH_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
FRENCH_I_VERBS = """îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is
    issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it""".split()
FRENCH_E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
FRENCH_A_VERBS = """âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez
    assions""".split()
SPANISH_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
SPANISH_E_VERBS = "en es éis emos".split()
SPANISH_VERBS = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería
    eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara
    iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as
    abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos
    ábamos íamos imos áramos iéramos iésemos ásemos""".split()


# ----------------------------------------------------------------- pieces

def _ending(word: Column, suffixes: Sequence[str]) -> Column:
    """The longest of the suffixes that the word ends with, or ''. The
    leftmost match of an end-anchored pattern is the longest."""
    return F.regexp_extract(word, "(?:" + "|".join(suffixes) + ")$", 0)


def _less(word: Column, n) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - (F.length(n) if isinstance(n, Column) else F.lit(n)))


def _in(word: Column, suffix, start: Column) -> Column:
    """Does the suffix (which the word ends with) lie in the region?"""
    n = F.length(suffix) if isinstance(suffix, Column) else F.lit(len(suffix))
    return F.length(word) - n >= start


def _region(word: Column, pattern: str) -> Column:
    """Characters up to the end of the pattern, or the whole word's length."""
    return F.when(word.rlike(pattern), F.length(F.regexp_extract(word, pattern, 0))).otherwise(F.length(word))


def _cut_if(word: Column, start: Column, suffixes: Sequence[str]) -> Column:
    """Without the longest of the suffixes, if it lies in the region."""
    s = _ending(word, suffixes)
    return F.when((s != "") & _in(word, s, start), _less(word, s)).otherwise(word)


class _Cascade:
    """A table of words that steps add columns to. Each step's value is a
    column of its own, so it is computed once however often the next uses it."""

    def __init__(self, terms: DataFrame):
        self.df = terms.select("term").withColumn("w", F.lower("term"))

    def step(self, **columns: Column) -> "_Cascade":
        self.df = self.df.withColumns({k: fence(v) for k, v in columns.items()})
        return self

    def regions(self, vowels: str, rv: Column | None = None) -> "_Cascade":
        once = f"^.*?[{vowels}][^{vowels}]"
        self.step(p1=_region(F.col("w"), once), p2=_region(F.col("w"), f"{once}.*?[{vowels}][^{vowels}]"))
        return self.step(pv=rv) if rv is not None else self


def _columns() -> tuple[Column, ...]:
    """The word, the starts of R1, R2 and RV, and the step's suffix."""
    return tuple(F.col(c) for c in ("w", "p1", "p2", "pv", "s"))


def _rv() -> Column:
    word, start = F.col("w"), F.col("pv")
    return F.substring(word, start + 1, F.greatest(F.length(word) - start, F.lit(0)))


# ---------------------------------------------------------------- english

def _english(c: _Cascade) -> Column:
    v = VOWELS["english"]
    W, P1, P2, PV, S = _columns()
    short = f"(?:^[{v}][^{v}]|[^{v}][{v}][^{v}wxY])$"
    c.step(w=F.regexp_replace(F.replace(W, F.lit("’"), F.lit("'")), "^'", ""))
    c.step(w=F.regexp_replace(W, f"(^|[{v}])y", "$1Y"))
    usual = _region(W, f"^.*?[{v}][^{v}]")
    c.step(p1=F.when(W.rlike("^(?:gener|arsen)"), 5).when(W.rlike("^commun"), 6).otherwise(usual))
    rest = F.substring(W, P1 + 1, F.greatest(F.length(W) - P1, F.lit(0)))
    c.step(p2=P1 + _region(rest, f"^.*?[{v}][^{v}]"))
    c.step(w=F.regexp_replace(W, "(?:'s'|'s|')$", ""))
    # 1a
    c.step(w=F.when(W.rlike("sses$"), _less(W, 2)).when(W.rlike("..ie[ds]$"), _less(W, 2))
           .when(W.rlike("ie[ds]$"), _less(W, 1)).when(W.rlike("(?:us|ss)$"), W)
           .when(W.rlike(f"[{v}].+s$"), _less(W, 1)).otherwise(W))
    c.step(kept=W.isin(ENGLISH_KEPT))
    # 1b
    c.step(s=_ending(W, ["eedly", "eed", "ingly", "edly", "ing", "ed"]))
    c.step(went=S.isin("ed", "edly", "ing", "ingly") & _less(W, S).rlike(f"[{v}]"))
    c.step(w=F.when(S.isin("eed", "eedly") & _in(W, S, P1), F.concat(_less(W, S), F.lit("ee")))
           .when(F.col("went"), _less(W, S)).otherwise(W))
    c.step(w=F.when(~F.col("went"), W).when(W.rlike("(?:at|bl|iz)$"), F.concat(W, F.lit("e")))
           .when(W.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _less(W, 1))
           .when(W.rlike(short) & (F.length(W) <= P1), F.concat(W, F.lit("e"))).otherwise(W))
    # 1c
    c.step(w=F.regexp_replace(W, f"^(.+[^{v}])[yY]$", "$1i"))
    # 2
    c.step(s=_ending(W, [*ENGLISH_STEP2, "ogi", "li"]))
    c.step(w=F.when((S == "") | ~_in(W, S, P1), W)
           .when(S == "ogi", F.when(W.rlike("logi$"), _less(W, 1)).otherwise(W))
           .when(S == "li", F.when(W.rlike("[cdeghkmnrt]li$"), _less(W, 2)).otherwise(W))
           .otherwise(F.concat(_less(W, S), _mapped(S, ENGLISH_STEP2))))
    # 3
    c.step(s=_ending(W, [*ENGLISH_STEP3, "ative"]))
    c.step(w=F.when((S == "") | ~_in(W, S, P1), W)
           .when(S == "ative", F.when(_in(W, S, P2), _less(W, S)).otherwise(W))
           .otherwise(F.concat(_less(W, S), _mapped(S, ENGLISH_STEP3))))
    # 4
    c.step(s=_ending(W, [*ENGLISH_STEP4, "ion"]))
    c.step(w=F.when((S == "") | ~_in(W, S, P2), W)
           .when(S == "ion", F.when(W.rlike("[st]ion$"), _less(W, 3)).otherwise(W)).otherwise(_less(W, S)))
    # 5
    c.step(w=F.when(W.endswith("e") & (_in(W, "e", P2) | (_in(W, "e", P1) & ~_less(W, 1).rlike(short))), _less(W, 1))
           .when(W.rlike("ll$") & _in(W, "l", P2), _less(W, 1)).otherwise(W))
    low = F.lower("term")
    known = F.when(low.isin(list(ENGLISH_EXCEPTIONS)), _mapped(low, ENGLISH_EXCEPTIONS))
    after = F.regexp_replace(F.lower("term"), "s$", "")
    return F.coalesce(known, F.when(F.length(low) <= 2, low), F.when(F.col("kept"), F.when(
        low.isin(ENGLISH_KEPT), low).otherwise(after)), F.replace(W, F.lit("Y"), F.lit("y")))


def _mapped(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, x in table.items():
        out = F.when(value == k, F.lit(x)).otherwise(out)
    return out


# ----------------------------------------------------------------- german

def _german(c: _Cascade) -> Column:
    v = VOWELS["german"]
    W, P1, P2, PV, S = _columns()
    c.step(w=F.replace(W, F.lit("ß"), F.lit("ss")))
    for letter in "uy":
        c.step(w=F.regexp_replace(W, f"(?<=[{v}]){letter}(?=[{v}])", letter.upper()))
    c.regions(v)
    c.step(p1=F.greatest(P1, F.lit(3)))
    # 1
    c.step(s=_ending(W, ["em", "ern", "er", "e", "en", "es", "(?<=[bdfghklmnrt])s"]))
    c.step(went=(S != "") & _in(W, S, P1))
    c.step(w=F.when(F.col("went"), _less(W, S)).otherwise(W))
    c.step(w=F.when(F.col("went") & S.isin("e", "en", "es") & W.endswith("niss"), _less(W, 1)).otherwise(W))
    # 2
    c.step(w=_cut_if(W, P1, ["en", "er", "est", "(?<=.{3}[bdfghklmnt])st"]))
    # 3
    c.step(s=_ending(W, ["end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"]))
    c.step(went=(S != "") & _in(W, S, P2) & ~(S.isin("ig", "ik", "isch") & _less(W, S).endswith("e")))
    c.step(w=F.when(F.col("went"), _less(W, S)).otherwise(W))
    more = F.when(S.isin("end", "ung") & W.rlike("(?<!e)ig$") & _in(W, "ig", P2), 2) \
        .when(S.isin("lich", "heit") & W.rlike("e[rn]$") & _in(W, "er", P1), 2) \
        .when((S == "keit") & W.endswith("lich") & _in(W, "lich", P2), 4) \
        .when((S == "keit") & W.endswith("ig") & _in(W, "ig", P2), 2).otherwise(0)
    c.step(w=F.when(F.col("went"), F.substring(W, F.lit(1), F.length(W) - more)).otherwise(W))
    return F.translate(F.lower(W), "äöü", "aou")


# ---------------------------------------------------------------- spanish

def _spanish(c: _Cascade) -> Column:
    v = VOWELS["spanish"]
    W, P1, P2, PV, S = _columns()
    c.regions(v, F.when(W.rlike(f"^.[^{v}]"), _region(W, f"^.[^{v}].*?[{v}]"))
              .when(W.rlike(f"^[{v}][{v}]"), _region(W, f"^..[{v}]*?[^{v}]"))
              .when(F.length(W) >= 3, F.lit(3)).otherwise(F.length(W)))
    # 0: attached pronouns
    c.step(s=_ending(_rv(), "me se sela selo selas selos la le lo las les los nos".split()))
    c.step(stem=_less(W, S))
    c.step(t=F.regexp_extract(F.substring(F.col("stem"), PV + 1, F.greatest(F.length("stem") - PV, F.lit(0))),
                              "(?:iéndo|ándo|ár|ér|ír|ando|iendo|ar|er|ir|yendo)$", 0))
    c.step(w=F.when((S == "") | (F.col("t") == ""), W)
           .when(F.col("t").isin("iéndo", "ándo", "ár", "ér", "ír"), F.concat(
               _less(F.col("stem"), F.col("t")), F.translate("t", "áéí", "aei")))
           .when((F.col("t") == "yendo") & ~F.col("stem").rlike("uyendo$"), W).otherwise(F.col("stem")))
    # 1: standard suffixes
    plain = """anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento
        amientos imiento imientos""".split()
    agent = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
    c.step(s=_ending(W, [*plain, *agent, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente",
                         "idad", "idades", "iva", "ivo", "ivas", "ivos"]), before=W)
    r2 = _in(W, S, P2)
    c.step(w=F.when(S == "", W).when(S.isin([*plain, *agent, "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]) & r2, _less(W, S))
           .when(S.isin("logía", "logías") & r2, F.concat(_less(W, S), F.lit("log")))
           .when(S.isin("ución", "uciones") & r2, F.concat(_less(W, S), F.lit("u")))
           .when(S.isin("encia", "encias") & r2, F.concat(_less(W, S), F.lit("ente")))
           .when((S == "amente") & _in(W, S, P1), _less(W, S)).otherwise(W))
    c.step(went=W != F.col("before"))
    c.step(w=F.when(~F.col("went"), W).when(S.isin(agent), _cut_if(W, P2, ["ic"]))
           .when((S == "amente") & W.endswith("iv") & _in(W, "iv", P2), _cut_if(_less(W, 2), P2, ["at"]))
           .when((S == "amente") & ~W.endswith("iv"), _cut_if(W, P2, ["os", "ic", "ad"]))
           .when(S == "mente", _cut_if(W, P2, ["ante", "able", "ible"]))
           .when(S.isin("idad", "idades"), _cut_if(W, P2, ["abil", "ic", "iv"]))
           .when(S.isin("iva", "ivo", "ivas", "ivos"), _cut_if(W, P2, ["at"])).otherwise(W))
    # 2: verbs
    c.step(s=F.when(~F.col("went"), _ending(_rv(), SPANISH_Y_VERBS)).otherwise(""))
    c.step(yes=(S != "") & _less(W, S).endswith("u"))
    c.step(w=F.when(F.col("yes"), _less(W, S)).otherwise(W))
    c.step(s=F.when(~F.col("went") & ~F.col("yes"), _ending(_rv(), [*SPANISH_E_VERBS, *SPANISH_VERBS])).otherwise(""))
    c.step(w=F.when(S == "", W).when(S.isin(SPANISH_E_VERBS), F.regexp_replace(_less(W, S), "gu$", "g"))
           .otherwise(_less(W, S)))
    # 3: residual suffix
    c.step(s=_ending(_rv(), ["os", "a", "o", "á", "í", "ó", "e", "é"]))
    c.step(w=F.when(S == "", W).when(S.isin("e", "é") & _less(W, S).endswith("gu") & (F.length(W) - 2 >= PV), _less(W, 2))
           .otherwise(_less(W, S)))
    return F.translate(W, "áéíóú", "aeiou")


# ----------------------------------------------------------------- french

def _french(c: _Cascade) -> Column:
    v = VOWELS["french"]
    W, P1, P2, PV, S = _columns()
    c.step(w=F.regexp_replace(W, "(?<=q)u", "U"))
    for letter in "ui":
        c.step(w=F.regexp_replace(W, f"(?<=[{v}]){letter}(?=[{v}])", letter.upper()))
    c.step(w=F.regexp_replace(W, f"(?<=[{v}])y|y(?=[{v}])", "Y"))
    c.regions(v, F.when(W.rlike("^(?:par|col|tap)") | W.rlike(f"^[{v}][{v}]."), F.lit(3)).otherwise(
        _region(W, f"^.[^{v}]*[{v}]")))
    plain = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
    agent = "atrice ateur ation atrices ateurs ations".split()
    adverbs = ["amment", "emment", "ment", "ments"]
    c.step(s=_ending(W, [*plain, *agent, "logie", "logies", "usion", "ution", "usions", "utions", "ence", "ences",
                         "ement", "ements", "ité", "ités", "if", "ive", "ifs", "ives", "eaux", "aux", "euse", "euses",
                         "issement", "issements", *adverbs]), before=W)
    r1, r2, rv, cut = _in(W, S, P1), _in(W, S, P2), _in(W, S, PV), _less(W, S)
    put = lambda text: F.concat(cut, F.lit(text))
    c.step(w=F.when(S == "", W)
           .when(S.isin([*plain, *agent, "ité", "ités", "if", "ive", "ifs", "ives"]), F.when(r2, cut).otherwise(W))
           .when(S.isin("logie", "logies"), F.when(r2, put("log")).otherwise(W))
           .when(S.isin("usion", "ution", "usions", "utions"), F.when(r2, put("u")).otherwise(W))
           .when(S.isin("ence", "ences"), F.when(r2, put("ent")).otherwise(W))
           .when(S.isin("ement", "ements"), F.when(rv, cut).otherwise(W))
           .when(S == "eaux", put("eau")).when(S == "aux", F.when(r1, put("al")).otherwise(W))
           .when(S.isin("euse", "euses"), F.when(r2, cut).when(r1, put("eux")).otherwise(W))
           .when(S.isin("issement", "issements"), F.when(r1 & cut.rlike(f"[^{v}]$"), cut).otherwise(W))
           .when(S == "amment", F.when(rv, put("ant")).otherwise(W))
           .when(S == "emment", F.when(rv, put("ent")).otherwise(W))
           # the vowel before must lie in RV too
           .otherwise(F.when(cut.rlike(f"[{v}]$") & (F.length(cut) - 1 >= PV), cut).otherwise(W)))
    c.step(went=W != F.col("before"))
    ic = F.when(W.endswith("ic"), F.when(_in(W, "ic", P2), _less(W, 2)).otherwise(F.concat(_less(W, 2), F.lit("iqU")))) \
        .otherwise(W)
    c.step(w=F.when(~F.col("went"), W).when(S.isin(agent), ic)
           .when(S.isin("ement", "ements"), F.when(W.endswith("iv"), F.when(_in(W, "iv", P2), _cut_if(
               _less(W, 2), P2, ["at"])).otherwise(W))
               .when(W.endswith("eus"), F.when(_in(W, "eus", P2), _less(W, 3)).when(
                   _in(W, "eus", P1), F.concat(_less(W, 1), F.lit("x"))).otherwise(W))
               .when(W.rlike("(?:abl|iqU)$"), _cut_if(W, P2, ["abl", "iqU"]))
               .when(W.rlike("[iI]èr$"), F.when(_in(W, "ièr", PV), F.concat(_less(W, 3), F.lit("i"))).otherwise(W))
               .otherwise(W))
           .when(S.isin("ité", "ités"), F.when(W.endswith("abil"), F.when(_in(W, "abil", P2), _less(W, 4)).otherwise(
               F.concat(_less(W, 4), F.lit("abl")))).when(W.endswith("ic"), ic).otherwise(_cut_if(W, P2, ["iv"])))
           .when(S.isin("if", "ive", "ifs", "ives"), F.when(W.endswith("at") & _in(W, "at", P2), F.concat(
               F.lit("\u0001"), _less(W, 2))).otherwise(W)).otherwise(W))
    # "at" went before "if": then "ic" as above
    c.step(mark=W.startswith("\u0001"), w=F.replace(W, F.lit("\u0001"), F.lit("")))
    c.step(w=F.when(F.col("mark"), ic).otherwise(W))
    # 2a: verbs that begin with i
    c.step(verbs=~F.col("went") | S.isin(adverbs) , changed=F.col("went"))
    c.step(s=F.when(F.col("verbs"), _ending(_rv(), FRENCH_I_VERBS)).otherwise(""))
    # the letter before the suffix is no vowel, and in RV
    c.step(yes=(S != "") & _less(_rv(), S).rlike(f"[^{v}]$"))
    c.step(w=F.when(F.col("yes"), _less(W, S)).otherwise(W))
    # 2b: other verbs
    c.step(s=F.when(F.col("verbs") & ~F.col("yes"), _ending(_rv(), ["ions", *FRENCH_E_VERBS, *FRENCH_A_VERBS])).otherwise(""))
    c.step(also=(S != "") & ((S != "ions") | _in(W, S, P2)))
    c.step(w=F.when(~F.col("also"), W).when(S.isin(FRENCH_A_VERBS) & _less(_rv(), S).endswith("e"), _less(_less(W, S), 1))
           .otherwise(_less(W, S)))
    c.step(changed=F.col("changed") | F.col("yes") | F.col("also"))
    # 3 if something was taken away, else 4
    last = F.when(W.rlike("[^aiouès]s$"), _less(W, 1)).otherwise(W)
    c.step(w=F.when(F.col("changed"), F.regexp_replace(F.regexp_replace(W, "Y$", "i"), "ç$", "c")).otherwise(last))
    c.step(s=F.when(F.col("changed"), F.lit("")).otherwise(_ending(_rv(), ["ion", "ier", "ière", "Ier", "Ière", "e"])))
    c.step(w=F.when(S == "", W).when(S == "ion", F.when(_in(W, S, P2) & _less(_rv(), S).rlike("[st]$"), _less(W, S)).otherwise(W))
           .when(S == "e", _less(W, S)).otherwise(F.concat(_less(W, S), F.lit("i"))))
    # 5 and 6
    c.step(w=F.when(W.rlike("(?:enn|onn|ett|ell|eill)$"), _less(W, 1)).otherwise(W))
    c.step(w=F.regexp_replace(W, f"[éè]([^{v}]+)$", "e$1"))
    return F.lower(W)


RULES = {"english": _english, "french": _french, "german": _german, "spanish": _spanish}


def rule_mapping(terms: DataFrame, language: str = "english") -> DataFrame:
    """``term, stem`` of distinct words."""
    if language not in RULES:
        raise ValueError(f"language must be one of {LANGUAGES}")
    cascade = _Cascade(terms)
    stem = RULES[language](cascade)
    return cascade.df.select("term", fence(stem).alias("stem"))


def stem_features_by_rules(d: Dfm, language: str = "english") -> Dfm:
    """Replace features by their stems and merge counts; the parts of an
    n-gram (joined by ``_``) are stemmed one by one. Stems are computed for distinct words."""
    parts = d.long.select("term").distinct().select("term", F.posexplode(F.split("term", "_")).alias("i", "part"))
    stems = rule_mapping(parts.select(F.col("part").alias("term")).distinct(), language)
    whole = parts.join(stems.withColumnRenamed("term", "part"), "part").groupBy("term").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "stem"))), lambda s: s["stem"]), "_").alias("stem"))
    return stem_features(d, whole)
