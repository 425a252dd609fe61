"""Independent SQL for the registered queries, put together from the fixed values.

Rules are chains of common table expressions; patterns with look-ahead are restated with a captured tail, as the SQL
engine's regular expressions have none.
"""

from __future__ import annotations

from .functions import tables as t
from .sources.synthetic import MDM_RAW_SQL



def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def squeeze(c: str, least: int = 2) -> str:
    return rf"regexp_replace({c}, '\s{{{least},}}', ' ', 'g')"


def sql_map(items: dict[str, str], c: str) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in items.items()) + " END"


def numbers(items: dict[str, float], c: str, other: float) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in items.items()) + f" ELSE {other}::DOUBLE END"


class Chain:
    """Common table expressions, each on top of the one before."""

    def __init__(self, first: str, name: str = "s"):
        self.steps = [(f"{name}0", first)]
        self.name = name

    @property
    def last(self) -> str:
        return self.steps[-1][0]

    def then(self, sql: str) -> Chain:
        out = Chain.__new__(Chain)
        out.name, out.steps = self.name, [*self.steps]
        out.steps.append((f"{self.name}{len(self.steps)}", sql.replace("{in}", self.last)))
        return out

    def add(self, **columns: str) -> Chain:
        return self.then("SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + " FROM {in}")

    def put(self, **columns: str) -> Chain:
        return self.then("SELECT * REPLACE (" + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + ") FROM {in}")

    def select(self, sql: str, also: str = "") -> str:
        return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in self.steps) + also + " " + sql.replace("{in}", self.last)


def parse(chain: Chain) -> Chain:
    part = lambda i: strip(f"coalesce(string_split(FULL_ADDRESS, '|#|#')[{i}], '')")
    return chain.add(parsed_street=part(1), parsed_city=part(2), parsed_state=part(3), parsed_country=part(4), parsed_postal=part(5))


NAME_RULES = [
    (r"\s*\([^)]*\)\s*$", "removed_parenthetical"), (r"(?i)\s+C/[oO]\s+.*$", "removed_care_of"), (r"(?i)\s*-\s*Recap\s+\w+$", "removed_dept_code"),
    (r"(?i)\s*-\s*Mot$", "removed_dept_code"), (r"\s*-\s*\d+$", "removed_dept_code"), (r"\s+[A-Z]{2,4}\d{4,}$", "removed_alphanum_code"), (r"(?i)\s+Run\s+Rate$", "removed_run_rate"),
]


def names(chain: Chain) -> Chain:
    c = chain.add(cleaned_name=strip("coalesce(SOURCE_NAME, '')"), name_removed_parts="[]::VARCHAR[]", name_cleaning_actions="[]::VARCHAR[]")
    for pattern, action in NAME_RULES:
        hit = f"regexp_matches(cleaned_name, {q(pattern)})"
        c = c.put(
            cleaned_name=f"CASE WHEN {hit} THEN {strip(f'regexp_replace(cleaned_name, {q(pattern)}, {q(str())})')} ELSE cleaned_name END",
            name_removed_parts=f"CASE WHEN {hit} THEN list_append(name_removed_parts, {strip(f'regexp_extract(cleaned_name, {q(pattern)})')}) ELSE name_removed_parts END",
            name_cleaning_actions=f"CASE WHEN {hit} THEN list_append(name_cleaning_actions, {q(action)}) ELSE name_cleaning_actions END",
        )
    return c.put(cleaned_name=strip(squeeze(strip(rf"regexp_replace(cleaned_name, '\s*[-–—]\s*$', '')"))))


def fold(chain: Chain, column: str, log: str, rules, where: str = "true") -> Chain:
    for pattern, replacement, action in rules:
        hit = f"({where} AND regexp_matches({column}, {q(pattern)}))"
        chain = chain.put(**{column: f"CASE WHEN {hit} THEN regexp_replace({column}, {q(pattern)}, {q(replacement)}) ELSE {column} END", log: f"CASE WHEN {hit} THEN list_append({log}, {q(action)}) ELSE {log} END"})
    return chain


def _literal(s: str) -> str:
    return s.replace(".", r"\.")


FIRST_RULES = [(_literal(a) if a.endswith(".") else rf"\b{a}\b", b, f"expanded_{a}") for a, b in t.STREET_WORDS]


def _tail(pattern: str, replacement: str) -> tuple[str, str]:
    """A look-ahead at the end of a pattern as a captured tail."""
    if "(?!" in pattern:
        return pattern.replace(r"(?!\.)", r"([^.]|$)"), replacement + r"\1"
    if "(?=" in pattern:
        return pattern.replace("(?=", "("), replacement + r"\1"
    return pattern, replacement


def second_rules(lang: str, prefix: str = "expanded_"):
    return [(*_tail(p, r), f"{prefix}{p[:15]}") for p, r in t.STREET_RULES[lang]]


def gu(street: str, city: str, state: str, country: str, postal: str, with_postal: bool, values: list[str], otherwise: str) -> str:
    zip_ = rf"upper(regexp_replace({postal}, '\s+', '', 'g'))"
    hay = f"lower({street} || ' ' || {city} || ' ' || upper({strip(state)}) || ' ' || {zip_})" if with_postal else f"lower({street} || ' ' || {city} || ' ' || {state})"
    is_gu = f"upper({strip(country)}) = 'GU'"
    tests = [f"{zip_} LIKE 'GY%' OR contains({hay}, 'guernsey')", f"{zip_} LIKE 'JE%' OR contains({hay}, 'jersey')", f"contains({hay}, 'guatemala')", f"upper({strip(state)}) = 'GU' OR contains({hay}, 'guadalajara') OR {zip_} LIKE '18%' OR {zip_} LIKE '19%'"]
    return "CASE " + " ".join(f"WHEN {is_gu} AND ({a}) THEN {v}" for a, v in zip(tests, values, strict=True)) + f" ELSE {otherwise} END"


CODES = ["'GG'", "'JE'", "'GT'", "'ES'"]
REASONS = [q("GU code is Guam; address content indicates Guernsey"), q("GU code is Guam; address content indicates Jersey"), q("GU code is Guam; address content indicates Guatemala"), q("GU appears to be Spanish province Guadalajara, not country Guam")]
TITLE = r"array_to_string(list_transform(regexp_extract_all({c}, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1:1]) || lower(x[2:])), '')"


def addresses(chain: Chain) -> Chain:
    broken = "contains(parsed_street, chr(10))"
    c = chain.add(norm_street=f"CASE WHEN {broken} THEN {strip(r'''regexp_replace(parsed_street, '\n+', ', ', 'g')''')} ELSE parsed_street END", normalization_actions=f"CASE WHEN {broken} THEN ['fixed_embedded_newlines'] ELSE []::VARCHAR[] END")
    c = fold(c, "norm_street", "normalization_actions", FIRST_RULES)
    c = c.put(norm_street=strip(squeeze(r"regexp_replace(norm_street, 'N[º°]\.?\s*', 'No. ', 'g')")))
    known = sql_map(t.STATES_FIRST_PASS, "upper(st)")
    shout = "upper(ci) = ci AND lower(ci) <> ci AND length(ci) > 2"
    c = c.add(st=strip("parsed_state"), ci=strip("parsed_city")).add(st2=f"coalesce({known}, st)", norm_city=f"CASE WHEN {shout} THEN {TITLE.replace('{c}', 'ci')} ELSE ci END", norm_postal=strip("parsed_postal"))
    args = ("norm_street", "norm_city", "st2", "parsed_country", "parsed_postal", True)
    c = c.add(norm_country=gu(*args, CODES, f"upper({strip('parsed_country')})"), gu_action=gu(*args, ["'country_gu_to_gg_guernsey'", "'country_gu_to_je_jersey'", "'country_gu_to_gt_guatemala'", "'country_gu_to_es_guadalajara'"], "NULL"))
    province = f"CASE WHEN norm_country = 'ES' THEN {sql_map(t.STATES_ES, 'upper(st2)')} END"
    c = c.add(province=province)
    parts = f"[CASE WHEN {known} IS NOT NULL THEN 'expanded_state_' || st END, CASE WHEN {shout} THEN 'titlecased_city' END, gu_action, CASE WHEN province IS NOT NULL THEN 'expanded_es_state_' || st2 END]"
    return c.add(norm_state="coalesce(province, st2)").put(normalization_actions=f"list_concat(normalization_actions, list_filter({parts}, lambda x: x IS NOT NULL))")


def repaired(c: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        c = f"replace({c}, {q(a)}, {q(b)})"
    return c


#: The one repairable sequence of the synthetic relation.
MOJIBAKE = {"CafÃ©": "Café"}
CJK = "[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]"
CYRILLIC = "[\\x{0400}-\\x{04ff}]"
ARABIC = "[\\x{0600}-\\x{06ff}]"


LANGUAGE_WORDS = {
    "de": "der die und das ist nicht mit von den für auf ein eine im dem des sich auch als es an werden aus",
    "en": "the of and to in is that for it with as was on be at by this are from or an not have which you",
    "es": "el la los de y que en un una es por con para las se del al lo como más su no mi ha",
    "fr": "le la les de et des un une est que dans pour qui sur pas du avec au par plus ce en sont il elle",
}


def guess(c: str) -> dict[str, str]:
    """Words and counts by language for ``GUESSED``."""
    one = lambda lang: f"len(list_filter(w, lambda x: x IN ({', '.join(q(v) for v in LANGUAGE_WORDS[lang].split())})))"
    return {"w": rf"regexp_extract_all(lower({c}), '\p{{L}}+')"}, {f"g_{k}": one(k) for k in LANGUAGE_WORDS}


GUESSED = "CASE WHEN greatest(g_de, g_en, g_es, g_fr) = 0 THEN NULL WHEN g_de = greatest(g_de, g_en, g_es, g_fr) THEN 'de' WHEN g_en = greatest(g_de, g_en, g_es, g_fr) THEN 'en' WHEN g_es = greatest(g_de, g_en, g_es, g_fr) THEN 'es' ELSE 'fr' END"


def language(chain: Chain, by_words: bool = True) -> Chain:
    both = strip("cleaned_name || ' ' || parsed_street")
    words, scores = guess("hay0")
    c = chain.add(hay0=both).add(**words).add(**scores).add(by_words=f"CASE WHEN {str(by_words).lower()} AND length(hay0) > 10 THEN {GUESSED} END")
    has = lambda p: f"regexp_matches(hay0, {q(p)})"
    return c.add(
        detected_lang=f"CASE WHEN {has(CJK)} THEN 'zh' WHEN {has(CYRILLIC)} THEN 'ru' WHEN {has(ARABIC)} THEN 'ar' ELSE coalesce(by_words, {sql_map(t.COUNTRY_LANGUAGE, 'upper(parsed_country)')}, 'unknown') END",
        lang_method=f"CASE WHEN {has(CJK)} THEN 'script_cjk' WHEN {has(CYRILLIC)} THEN 'script_cyrillic' WHEN {has(ARABIC)} THEN 'script_arabic' WHEN by_words IS NOT NULL THEN 'function_words' ELSE 'country_fallback' END",
    )


GARBLE = "len(regexp_extract_all({c}, '[Ã¡-ÿ]{2,}')) / greatest(length({c}), 1)"


def flags(chain: Chain) -> Chain:
    ratio = lambda c: "(" + GARBLE.replace("{c}", c) + " > 0.1)"
    script = f"(regexp_matches(norm_street || cleaned_name, {q(CJK)}) OR regexp_matches(norm_street || cleaned_name, {q(CYRILLIC)}))"
    codes = ", ".join(q(v) for v in t.CODED_NAMES)
    c = chain.add(
        flag_no_street="parsed_street = ''", flag_no_street_number=r"parsed_street <> '' AND NOT regexp_matches(parsed_street, '\d')", flag_no_city="parsed_city = ''", flag_no_state="parsed_state = ''", flag_no_postal="parsed_postal = ''",
        flag_garbled_text=f"{ratio('norm_street')} OR {ratio('cleaned_name')}", flag_complex_address="length(norm_street) > 80", flag_name_has_codes=f"name_sub_category IN ({codes})", flag_non_latin=script,
    )
    c = c.add(api_ready="NOT (flag_no_street OR flag_garbled_text OR flag_no_city)")
    return c.add(needs_translation_1="flag_non_latin AND api_ready", quality_tier="CASE WHEN flag_no_street OR flag_garbled_text THEN 'CRITICAL' WHEN flag_no_state OR flag_no_postal OR flag_no_street_number THEN 'INCOMPLETE' WHEN flag_complex_address OR flag_non_latin THEN 'NEEDS_PREP' ELSE 'READY' END")


RAW = Chain(MDM_RAW_SQL)
PARSED = parse(RAW)
# repair at load comes before the flag compares, so the flag stays false for addresses
LOADED = RAW.put(FULL_ADDRESS=repaired("FULL_ADDRESS", MOJIBAKE))
FIRST = flags(language(addresses(names(parse(LOADED).add(flag_encoding_repaired="false")))))


def streets(chain: Chain, column: str, log: str) -> Chain:
    own = f"CASE WHEN detected_lang IN ({', '.join(q(k) for k in t.STREET_RULES)}) THEN detected_lang ELSE 'en' END"
    c = chain.add(own=own)
    for lang in t.STREET_RULES:
        c = fold(c, column, log, second_rules(lang), f"own = {q(lang)}")
    return fold(c, column, log, second_rules("en", "expanded_en_"), "own <> 'en'")


def structure(chain: Chain, column: str, log: str) -> Chain:
    note = lambda hit, name: f"CASE WHEN {hit} THEN list_append({log}, {q(name)}) ELSE {log} END"
    hit = f"contains({column}, chr(10))"
    c = chain.put(**{column: f"CASE WHEN {hit} THEN " + strip(rf"regexp_replace({column}, '\s*\n+\s*', ', ', 'g')") + f" ELSE {column} END", log: note(hit, "fixed_newlines")})
    hit = f"(contains({column}, ',,') OR contains({column}, ', ,'))"
    c = c.put(**{column: rf"CASE WHEN {hit} THEN regexp_replace({column}, ',\s*,+', ',', 'g') ELSE {column} END", log: note(hit, "fixed_double_commas")})
    c = c.put(**{column: squeeze(strip(rf"regexp_replace({column}, '^[,.\s]+|[,.\s]+$', '', 'g')"))})
    hit = f"regexp_matches({column}, 'N[º°]')"
    return c.put(**{column: rf"CASE WHEN {hit} THEN regexp_replace({column}, 'N[º°]\.?\s*', 'No. ', 'g') ELSE {column} END", log: note(hit, "normalized_number_sign")})


MX = {**t.STATES_MX, **{k[:-1]: v for k, v in t.STATES_MX.items() if k.endswith(".")}}


def state(c: str, country: str) -> tuple[str, str]:
    full = f"CASE WHEN {country} = 'MX' THEN {sql_map(MX, f'upper({strip(c)})')} WHEN {country} = 'ES' THEN {sql_map(t.STATES_ES, f'upper({strip(c)})')} END"
    return f"coalesce({full}, {c})", f"CASE WHEN {full} IS NOT NULL THEN CASE WHEN {country} = 'MX' THEN 'expanded_state_' ELSE 'expanded_es_state_' END || {c} END"


def postal(c: str, country: str) -> tuple[str, str]:
    p, d, n = strip(c), f"regexp_replace({c}, '[^0-9]', '', 'g')", f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"
    tight = rf"upper(regexp_replace({c}, '\s+', '', 'g'))"
    rules = [
        (f"{p} = '' OR {p} = 'nan'", "''", "NULL"), (f"{country} = 'US' AND {n} = 9", f"left({d}, 5) || '-' || right({d}, 4)", "'formatted_zip_plus4'"), (f"{country} = 'US' AND {n} >= 5", f"left({d}, 5)", "'normalized_zip5'"),
        (rf"{country} = 'CA' AND length({tight}) = 6 AND regexp_matches({tight}, '^[A-Z]\d[A-Z]\d[A-Z]\d')", f"left({tight}, 3) || ' ' || right({tight}, 3)", "'formatted_ca_postal'"),
        (f"{country} IN ('GB', 'GG', 'JE') AND length({tight}) >= 5", f"left({tight}, length({tight}) - 3) || ' ' || right({tight}, 3)", "'formatted_uk_postal'"),
        (f"{country} IN ('DE', 'ES', 'IT', 'FR', 'BE', 'NL', 'AT') AND {n} > 0", d, "'cleaned_eu_postal'"), (f"{country} = 'BR' AND {n} = 8", f"left({d}, 5) || '-' || right({d}, 3)", "'formatted_br_postal'"),
        (f"{country} IN ('CN', 'RU', 'SA', 'MX', 'CL', 'GT') AND {n} > 0", d, f"'cleaned_' || lower({country}) || '_postal'"),
    ]
    return "CASE " + " ".join(f"WHEN {a} THEN {v}" for a, v, _ in rules) + f" ELSE {p} END", "CASE " + " ".join(f"WHEN {a} THEN {w}" for a, _, w in rules) + " END"


def check(chain: Chain) -> Chain:
    args = ("enhanced_street", "norm_city", "enhanced_state", "norm_country", "enhanced_postal", False)
    c = chain.add(why1=gu(*args, REASONS, "NULL"), c0=gu(*args, CODES, f"upper({strip('norm_country')})")).add(c1="CASE WHEN why1 IS NOT NULL THEN c0 ELSE norm_country END", hay="enhanced_street || ' ' || norm_city || ' ' || cleaned_name")
    cjk = f"regexp_matches(hay, {q(CJK)})"
    script = f"{cjk} AND c1 NOT IN ({', '.join(q(k) for k in t.CJK_COUNTRIES)})"
    inland = f"{cjk} AND c1 = 'HK' AND ({' OR '.join(f'contains(hay, {q(k)})' for k in t.MAINLAND_CITIES)})"
    c = c.add(c2=f"CASE WHEN ({script}) OR ({inland}) THEN 'CN' ELSE c1 END", why2=f"CASE WHEN {script} THEN 'CJK characters in address but country is not CJK' WHEN {inland} THEN 'Address contains mainland China city but tagged as HK' ELSE why1 END", expected=sql_map(t.CITY_COUNTRY, f"lower({strip('norm_city')})"))
    wrong = "expected IS NOT NULL AND c2 <> expected"
    c = c.add(suggested_country=f"CASE WHEN {wrong} THEN expected ELSE c2 END", country_mismatch_reason=f"coalesce(CASE WHEN {wrong} THEN 'City ''' || norm_city || ''' typically in ' || expected || ', tagged as ' || norm_country ELSE why2 END, '')")
    return c.add(country_validated="country_mismatch_reason = ''")


def complete(chain: Chain) -> Chain:
    n = lambda c: f"length({strip(c)})"
    c = chain.add(has_street=f"{n('enhanced_street')} > 2", has_street_number=r"regexp_matches(enhanced_street, '\d')", has_city=f"{n('norm_city')} > 1", has_state=f"{strip('enhanced_state')} NOT IN ('', 'nan')", has_country=f"{n('suggested_country')} = 2", has_postal=f"{n('enhanced_postal')} >= 3 AND enhanced_postal <> 'nan'")
    c = c.add(points="has_street::INT + has_street_number::INT + has_city::INT + has_state::INT + has_country::INT + has_postal::INT")
    return c.add(completeness_score="round(points / 6, 2)", completeness_class="CASE WHEN points >= 5 AND has_street AND has_street_number THEN 'FULL' WHEN points >= 3 AND has_city THEN 'PARTIAL' WHEN points >= 2 THEN 'MINIMAL' ELSE 'EMPTY' END")


def composed(chain: Chain) -> Chain:
    s = strip
    parts = f"[nullif({s('enhanced_street')}, ''), nullif({s('norm_city')}, ''), CASE WHEN upper({s('enhanced_state')}) <> upper({s('suggested_country')}) THEN nullif(nullif({s('enhanced_state')}, ''), 'nan') END, nullif(nullif({s('enhanced_postal')}, ''), 'nan'), nullif({s('suggested_country')}, '')]"
    need = "detected_lang IN ('zh', 'ja', 'ko', 'ru', 'ar', 'he', 'th')"
    return chain.add(
        api_address=f"array_to_string(list_filter({parts}, lambda x: x IS NOT NULL), ', ')", needs_translation=need,
        api_strategy="CASE WHEN detected_lang IN ('zh', 'ja', 'ko') THEN 'direct_cjk' WHEN detected_lang IN ('ru', 'ar', 'he', 'th') THEN 'needs_transliteration' ELSE 'direct' END",
        translation_handling_status=f"CASE WHEN {need} THEN 'TRANSLATION_NOT_CONFIGURED' ELSE 'NOT_NEEDED_LATIN_SCRIPT' END",
        translation_gap_reason=f"CASE WHEN {need} THEN 'Azure Translator is not enabled/configured; Unicode source fields are retained.' ELSE '' END",
    )


LOG = "enhanced_preprocessing_actions"
_s, _sa = state("norm_state", "norm_country")
_p, _pa = postal("norm_postal", "norm_country")
SECOND = structure(streets(FIRST.add(enhanced_street="norm_street", **{LOG: "[]::VARCHAR[]"}), "enhanced_street", LOG), "enhanced_street", LOG)
SECOND = composed(complete(check(SECOND.add(enhanced_state=_s, enhanced_postal=_p).put(**{LOG: f"list_concat({LOG}, list_filter([{_sa}, {_pa}], lambda x: x IS NOT NULL))"}))))


def parts_of(c: str) -> str:
    return f"list_transform(string_split({c}, ','), lambda x: {strip('x')})"


def simulated(chain: Chain, a: str, c: str, p: str) -> Chain:
    """Columns ``<p>status``, ``<p>notes``, ``<p>text``, ``<p>lat``, ``<p>lon``; all null where the address is."""
    h = f"('0x' || substr(md5({a}), 1, 8))::BIGINT"
    out = chain.add(**{f"{p}num": rf"regexp_matches({a}, '\d')", f"{p}st": rf"regexp_matches({a}, '(?i)\b({t.STREET_TYPES})\b')", f"{p}parts": f"len(list_filter({parts_of(a)}, lambda x: x <> ''))", f"{p}h": h})
    out = out.add(**{f"{p}f": f"({p}h % 1000) / 1000.0", f"{p}score": f"CASE WHEN {p}num THEN 30 ELSE 0 END + CASE WHEN {p}st THEN 25 ELSE 0 END + CASE WHEN {p}parts >= 3 THEN 20 ELSE 0 END + CASE WHEN {p}parts >= 4 THEN 10 ELSE 0 END + CASE WHEN length({a}) > 20 THEN 10 ELSE 0 END + CASE WHEN {c} IN ('US', 'GB', 'CA', 'AU', 'DE', 'FR') THEN 5 ELSE 0 END"})
    f, s = f"{p}f", f"{p}score"
    out = out.add(**{f"{p}status": f"CASE WHEN {a} IS NULL THEN NULL WHEN {s} >= 70 THEN CASE WHEN {f} < 0.65 THEN 'VALIDATED' WHEN {f} < 0.90 THEN 'CORRECTED' ELSE 'PARTIAL_MATCH' END WHEN {s} >= 40 THEN CASE WHEN {f} < 0.30 THEN 'CORRECTED' WHEN {f} < 0.60 THEN 'PARTIAL_MATCH' ELSE 'FAILED' END ELSE 'FAILED' END"})
    st = f"{p}status"
    top, mid, low = f"{s} >= 70", f"({s} >= 40 AND {s} < 70)", f"{s} < 40"
    items = [
        (rf"{top} AND {st} = 'CORRECTED' AND NOT regexp_matches({a}, '\d{{5}}') AND {c} = 'US'", "postal_code: inferred"), (f"{top} AND {st} = 'CORRECTED' AND {f} > 0.80", "street_number: confirmed with correction"),
        (f"{mid} AND {st} = 'CORRECTED'", "street: partially matched and corrected"), (f"{mid} AND {st} = 'CORRECTED' AND NOT {p}num", "street_number: missing, inferred from context"),
        (f"{st} = 'PARTIAL_MATCH'", "address: matched to route level only"), (f"{mid} AND {st} = 'FAILED'", "address: insufficient match confidence"),
        (f"NOT {p}num AND ((({mid}) AND {st} IN ('PARTIAL_MATCH', 'FAILED')) OR {low})", "street_number: missing"), (f"{mid} AND {st} = 'FAILED' AND NOT {p}st", "street_name: unrecognized format"),
        (f"{low} AND NOT {p}st", "street_name: unrecognized"), (f"{low} AND {p}parts < 3", "address: insufficient components"),
    ]
    notes = "list_filter([" + ", ".join(f"CASE WHEN {test} THEN {q(w)} END" for test, w in items) + "], lambda x: x IS NOT NULL)"
    good = f"{st} IN ('VALIDATED', 'CORRECTED')"
    pieces = parts_of(strip(a))
    text = f"array_to_string(CASE WHEN len({pieces}) >= 2 THEN list_append(list_slice({pieces}, 1, len({pieces}) - 1), upper({pieces}[-1])) ELSE {pieces} END, ', ')"
    return out.add(**{
        f"{p}notes": notes, f"{p}text": f"CASE WHEN {good} THEN {text} ELSE '' END", f"{p}lat": f"CASE WHEN {good} THEN round({numbers(t.LATITUDE, c, 40.0)} + ({f} - 0.5) * 5, 6) END",
        f"{p}lon": f"CASE WHEN {good} THEN round({numbers(t.LONGITUDE, c, 0.0)} + (({p}h % 100) / 100.0 - 0.5) * 10, 6) END", f"{p}gran": f"CASE WHEN {good} THEN 'PREMISE' WHEN {st} = 'PARTIAL_MATCH' THEN 'ROUTE' ELSE 'OTHER' END",
    })


SIM = simulated(SECOND, "api_address", "suggested_country", "r_")


def corrected(chain: Chain) -> Chain:
    a = "api_address"
    blames = lambda w: f"(len(list_filter(r_notes, lambda x: contains(x, '{w}'))) > 0)"
    pieces = parts_of(a)
    short = rf"({blames('postal')} AND (regexp_matches({pieces}[-1], '^[\d\s-]{{3,10}}$') OR regexp_matches({pieces}[-1], '^[A-Z0-9\s]{{3,10}}$')))"
    kept = f"CASE WHEN {short} THEN array_to_string(list_slice({pieces}, 1, len({pieces}) - 1), ', ') ELSE {a} END"
    fixed = rf"CASE WHEN {blames('street_number')} THEN regexp_replace({kept}, '^\d+[-/]?\d*\s*', '') ELSE {kept} END"
    plain = rf"regexp_replace(regexp_replace(regexp_replace({a}, '(?i),?\s*({t.UNIT_WORDS})\.?\s*\S*', '', 'g'), '\s*\([^)]*\)', '', 'g'), '\s*No\.?\s*\d+', '', 'g')"
    plain = strip(f"regexp_replace({strip(plain)}, ',+$', '')")
    wide = f"CASE WHEN len({pieces}) >= 3 THEN array_to_string(list_slice({pieces}, len({pieces}) - 2, len({pieces})), ', ') END"
    c = chain.add(**{f"try{i}": f"nullif(nullif({e}, {a}), '')" for i, e in enumerate((fixed, plain, wide))})
    for i in range(3):
        c = simulated(c, f"try{i}", "suggested_country", f"t{i}_")
    won = [f"t{i}_status IN ('VALIDATED', 'CORRECTED', 'PARTIAL_VALIDATED')" for i in range(3)]
    made = [f"(try{i} IS NOT NULL)::INT" for i in range(3)]
    pick = lambda f, other: "CASE " + " ".join(f"WHEN {won[i]} THEN {f(i)}" for i in range(3)) + f" ELSE {other} END"
    return c.add(
        k_status=pick(lambda i: f"t{i}_status", "'FAILED'"), k_strategy=pick(lambda i: ["'component_fix'", "'simplify_address'", "'broaden_search'"][i], "NULL"), k_attempts=pick(lambda i: "(" + " + ".join(made[: i + 1]) + ")", "(" + " + ".join(made) + ")"),
        k_text=pick(lambda i: f"t{i}_text", "NULL"), k_gran=pick(lambda i: f"t{i}_gran", "NULL"), k_notes=pick(lambda i: f"t{i}_notes", "NULL"),
    )


CORRECTED = corrected(SIM)


def settled(chain: Chain) -> Chain:
    has = lambda w: f"len(list_filter(r_notes, lambda x: contains(x, '{w}'))) > 0"
    r = t.FAILURE_REASONS
    said = rf"array_to_string(list_filter([CASE WHEN NOT regexp_matches(api_address, '\d') THEN {q(r['digit'])} END, CASE WHEN length({strip('api_address')}) < 10 THEN {q(r['short'])} END, CASE WHEN {has('unrecognized')} THEN {q(r['unrecognized'])} END, CASE WHEN {has('insufficient')} THEN {q(r['insufficient'])} END], lambda x: x IS NOT NULL), '; ')"
    c = chain.add(b=f"CASE WHEN {strip('api_address')} = '' OR completeness_class = 'EMPTY' THEN 'skip' WHEN r_status IN ('VALIDATED', 'CORRECTED') THEN 'direct' WHEN k_status IN ('CORRECTED', 'PARTIAL_VALIDATED') THEN 'fixed' ELSE 'failed' END")
    return c.add(
        validation_status="CASE b WHEN 'skip' THEN 'SKIPPED' WHEN 'direct' THEN r_status WHEN 'fixed' THEN k_status ELSE 'FAILED' END", validated_address="CASE b WHEN 'direct' THEN r_text WHEN 'fixed' THEN k_text END",
        validation_granularity="CASE b WHEN 'skip' THEN NULL WHEN 'fixed' THEN k_gran ELSE r_gran END", validation_diagnostics="CASE b WHEN 'skip' THEN NULL WHEN 'fixed' THEN k_notes ELSE r_notes END",
        correction_status="CASE b WHEN 'direct' THEN CASE WHEN r_status = 'CORRECTED' THEN 'API_CORRECTED' END WHEN 'fixed' THEN 'ENGINE_CORRECTED' WHEN 'failed' THEN 'EXHAUSTED' END", correction_strategy="CASE b WHEN 'direct' THEN CASE WHEN r_status = 'CORRECTED' THEN 'api_auto' END WHEN 'fixed' THEN k_strategy END",
        correction_attempts="CASE b WHEN 'direct' THEN CASE WHEN r_status = 'CORRECTED' THEN 1 ELSE 0 END WHEN 'skip' THEN NULL ELSE k_attempts END", failure_reason=f"CASE b WHEN 'skip' THEN 'No usable address for API submission' WHEN 'failed' THEN CASE WHEN k_status = 'VALIDATED' THEN 'Unknown' ELSE coalesce(nullif({said}, ''), {q(r['none'])}) END END",
        manual_review_flag="b IN ('skip', 'failed')",
    )


VALIDATED = settled(CORRECTED)
USABLE = VALIDATED.then("SELECT * FROM {in} WHERE validation_status IN ('VALIDATED', 'CORRECTED', 'PARTIAL_VALIDATED')")


def normal(c: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\s]', ' ', 'g'), '\b(inc|llc|ltd|co|company|corp|corporation|gmbh|sa|srl|spa|plc)\b', ' ', 'g'), '\s+', ' ', 'g')")


def token_set(c: str) -> str:
    return f"list_distinct(list_filter(string_split({normal(c)}, ' '), lambda x: x <> ''))"


def similarity(a: str, b: str) -> str:
    x, y = token_set(a), token_set(b)
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END"


THIRD = USABLE.add(va="coalesce(nullif(validated_address, ''), api_address)").add(sim=f"({similarity('cleaned_name', 'va')})::DOUBLE").add(v_status="CASE WHEN sim > 0.20 THEN 'LIKELY_MATCH' ELSE 'UNVERIFIED' END", v_conf="round(greatest(sim, 0.25), 3)")
THIRD = THIRD.add(legal_name="cleaned_name", enriched_full_address="CASE WHEN v_status = 'LIKELY_MATCH' THEN va ELSE coalesce(validated_address, '') END", dom=f"array_to_string(list_filter(string_split({normal('cleaned_name')}, ' '), lambda x: x <> '')[1:3], '')")
THIRD = THIRD.add(email_domain="CASE WHEN v_status = 'LIKELY_MATCH' AND length(dom) >= 4 THEN dom || '.com' ELSE '' END", review_routing="CASE WHEN v_status = 'LIKELY_MATCH' THEN 'AUTO_ENRICH' ELSE 'DEFER_NO_EVIDENCE' END")


def counts(chain: Chain, column: str, alias: str, where: str = "true") -> str:
    return chain.select(f"SELECT {column} AS {alias}, count(*) AS n FROM {{in}} WHERE {column} IS NOT NULL AND {where} GROUP BY 1")


def unnested(chain: Chain, column: str) -> str:
    return chain.select(f"SELECT action, count(*) AS n FROM (SELECT unnest({column}) AS action FROM {{in}}) GROUP BY 1")


def pick(values: list[str], k: str) -> str:
    return "([" + ", ".join(q(v) for v in values) + f"])[({k}) % {len(values)} + 1]"


RATE = "round(100 * {n} / greatest(count(*), 1), 1)"
EXACT = "count(*) FILTER (validation_status IN ('VALIDATED', 'CORRECTED'))"
USE = "count(*) FILTER (validation_status IN ('VALIDATED', 'CORRECTED', 'PARTIAL_VALIDATED'))"
OF = lambda v: f"count(*) FILTER (validation_status = '{v}')"


def rates(column: str) -> str:
    return f"SELECT '{column}' AS kind, {column} AS value, count(*) AS total, {EXACT} AS exact_success, {USE} AS usable_success, {RATE.replace('{n}', EXACT)} AS exact_success_rate, {RATE.replace('{n}', USE)} AS usable_success_rate FROM {{in}} GROUP BY {column}"


SCORED = """
WITH s AS (SELECT s_suppkey, s_nationkey, 'Acme ' || (s_suppkey % 7) || ' Tools Inc' AS company_name, (s_suppkey % 5) || ' Main Street' AS address, (s_suppkey % 10) / 100 AS latitude FROM supplier),
c AS (SELECT c_nationkey, c_custkey AS ord, 'ACME ' || (c_custkey % 7) || CASE WHEN c_custkey % 3 = 0 THEN ' Tools GmbH' ELSE ' Paints Ltd' END AS c_name, (c_custkey % 5) || CASE WHEN c_custkey % 2 = 0 THEN ' main street' ELSE ' high street' END AS c_address, (c_custkey % 10) / 100 AS c_latitude, (c_custkey % 13) / 10 AS c_score FROM customer),
p AS (SELECT *, SIM1 AS n, SIM2 AS a, CASE WHEN abs(latitude - c_latitude) <= 0.001 THEN 1.0 WHEN abs(latitude - c_latitude) <= 0.01 THEN 0.75 WHEN abs(latitude - c_latitude) <= 0.05 THEN 0.45 ELSE 0.10 END::DOUBLE AS d, least(c_score, 1.0) AS g FROM s JOIN c ON s_nationkey = c_nationkey),
z AS (SELECT *, round(n, 3) AS name_score, round(a, 3) AS address_score, round(d, 3) AS distance_score, round(0.45::DOUBLE * n + 0.30::DOUBLE * a + 0.20::DOUBLE * d + 0.05::DOUBLE * g, 3) AS confidence FROM p),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY confidence DESC, ord) AS rn FROM z) WHERE rn = 1)
""".replace("SIM1", f"({similarity('company_name', 'c_name')})::DOUBLE").replace("SIM2", f"({similarity('address', 'c_address')})::DOUBLE")
GENERIC = ", ".join(q(w) for w in t.GENERIC_PLACES)



def key(c: str) -> str:
    return strip(f"regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')")


EVIDENCE = f"""
WITH ev AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'M-' || o_custkey ELSE '' END AS k1, CASE WHEN o_orderkey % 3 = 1 THEN 's ' || o_custkey ELSE '' END AS k2, CASE WHEN o_orderkey % 5 > 0 THEN 'order ' || o_orderkey ELSE '' END AS txt, 'http://x/' || o_orderkey AS url FROM orders),
keys AS (SELECT {key('k1')} AS k, o_orderkey, 1 AS p, txt, url FROM ev WHERE k1 <> '' UNION ALL SELECT {key('k2')}, o_orderkey, 2, txt, url FROM ev WHERE k2 <> ''),
idx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderkey DESC, p DESC) AS rn FROM keys) WHERE rn = 1),
hit AS (SELECT c_custkey AS row_id, a.txt AS t1, a.url AS u1, b.txt AS t2, b.url AS u2 FROM customer LEFT JOIN idx a ON a.k = {key("'m ' || c_custkey")} LEFT JOIN idx b ON b.k = {key("'S_' || c_custkey")})
SELECT row_id, coalesce(u1, u2) IS NOT NULL AS external_evidence_available, CASE WHEN coalesce(u1, u2) IS NOT NULL THEN 'external_evidence_file' ELSE '' END AS external_evidence_source, coalesce(u1, u2, '') AS external_evidence_url,
  CASE WHEN u1 IS NOT NULL THEN t1 ELSE coalesce(t2, '') END AS external_evidence_text FROM hit
"""

ADJUDICATED = """
WITH e AS (SELECT event_id, (['ADDRESS_MISMATCH', 'CORRECT_ADDRESS_CANDIDATE', 'UNVERIFIED', 'VERIFIED'])[(event_id // 5) % 4 + 1] AS st, (event_id % 100) / 100 AS det, event_id % 4 > 0 AS named, event_id % 6 = 0 AS ev,
  event_id % 11 = 0 AS silent, upper((['VERIFIED', 'likely_match', 'ADDRESS_MISMATCH', 'maybe', 'UNVERIFIED'])[event_id % 5 + 1]) AS said, round(least(CASE WHEN event_id % 120 > 1 THEN (event_id % 120) / 100 ELSE event_id % 120 END, 1.0), 3)::DOUBLE AS ai FROM events),
w AS (SELECT *, (st IN ('ADDRESS_MISMATCH', 'CORRECT_ADDRESS_CANDIDATE') OR (st = 'UNVERIFIED' AND ev)) AND (named OR ev) AS wanted, CASE WHEN said = 'MAYBE' THEN st ELSE said END AS dec FROM e),
r AS (SELECT *, wanted AND NOT silent AS ran, dec IN ('VERIFIED', 'LIKELY_MATCH') AND ai >= 0.75 AS prom FROM w),
a AS (SELECT event_id, CASE WHEN ran THEN dec ELSE 'NOT_RUN' END AS ai_adjudication_status, CASE WHEN ran THEN ai ELSE 0.0 END::DOUBLE AS ai_adjudication_confidence, CASE WHEN ran THEN 'r ' || (event_id % 3) WHEN wanted THEN 'OpenAI adjudication returned non-JSON content' ELSE '' END AS ai_adjudication_reason,
  CASE WHEN ran THEN 'azure_openai_candidate_adjudication' ELSE '' END AS ai_adjudication_method, ran AND prom AS ai_promoted_match, CASE WHEN ran AND prom THEN dec ELSE st END AS final_company_verification_status,
  CASE WHEN NOT ran THEN round(det, 3) WHEN prom THEN round(0.45::DOUBLE * det + 0.55::DOUBLE * ai, 3) WHEN dec IN ('ADDRESS_MISMATCH', 'CORRECT_ADDRESS_CANDIDATE', 'UNVERIFIED') THEN greatest(det, ai) ELSE det END::DOUBLE AS overall_confidence_score FROM r)
"""

_words, _scores = guess("coalesce(text, '')")
GUESS = f"WITH d AS (SELECT doc_id, {_words['w']} AS w FROM documents), s AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _scores.items())} FROM d) SELECT doc_id, {GUESSED} AS guess FROM s"

def label(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def canonical(c: str) -> str:
    c = f"lower({c})"
    for pattern, word in t.ADDRESS_WORDS:
        c = f"regexp_replace({c}, {q(pattern)}, {q(word)}, 'g')"
    return strip(f"regexp_replace(regexp_replace({c}, {q(t.COUNTRY_WORDS)}, ' ', 'g'), '[^a-z0-9]+', ' ', 'g')")


def answered(chain: Chain, a: str, p: str, found: str, score: str, kind: str, match: str, text: str, parts: dict[str, str]) -> Chain:
    """A geocoder's answer to ``a`` as ``<p>status``, ``<p>gran``, ``<p>text``, ``<p>notes``, ``<p>inferred``, ``<p>replaced``, ``<p>loose``."""
    c = chain.add(**{f"{p}found": found, f"{p}s": f"({score})::DOUBLE", f"{p}kind": label(kind), f"{p}match": label(match), f"{p}raw": text, **{f"{p}{k}": f"({v}) <> ''" for k, v in parts.items()}})
    best = f"coalesce(nullif({p}match, ''), nullif({p}kind, ''), '')"
    c = c.add(**{
        f"{p}g": f"CASE WHEN {best} = 'pointaddress' THEN 'PREMISE' WHEN {best} = 'addressrange' THEN CASE WHEN {p}street_number THEN 'PREMISE' ELSE 'ROUTE' END WHEN {best} IN ('address', 'streetaddress') AND {p}street_number THEN 'PREMISE' WHEN {best} IN ('street', 'streetname') THEN 'ROUTE' WHEN {best} IN ({', '.join(q(v) for v in t.LOCALITIES)}) THEN 'LOCALITY' ELSE 'OTHER' END",
        f"{p}x": canonical(f"{p}raw"), f"{p}y": canonical(f"coalesce({a}, '')"),
    })
    c = c.add(**{f"{p}inf": f"{p}s >= 0.80 AND NOT ({p}x <> '' AND {p}y <> '' AND (contains({p}x, {p}y) OR contains({p}y, {p}x)))"})
    head = strip(f"split_part({a}, ',', 1)")
    concrete = rf"(NOT regexp_matches({a}, '(?i){t.PLACEHOLDERS}') AND (regexp_matches({head}, '\d') OR regexp_matches({head}, '(?i)^\s*({t.NUMBER_WORDS})\b')))"
    s, g = f"{p}s", f"{p}g"
    status = f"CASE WHEN NOT {p}found THEN 'FAILED' WHEN {s} >= 0.80 AND {g} = 'PREMISE' THEN CASE WHEN {p}inf THEN 'CORRECTED' ELSE 'VALIDATED' END WHEN {s} >= 0.70 AND {g} = 'PREMISE' THEN 'PARTIAL_VALIDATED' WHEN {s} >= 0.90 AND {g} = 'ROUTE' AND {p}street_name THEN 'PARTIAL_VALIDATED' WHEN {s} >= 0.85 AND {g} = 'ROUTE' AND {p}street_name AND {concrete} THEN 'PARTIAL_VALIDATED' WHEN {s} >= 0.60 AND {g} IN ('ROUTE', 'LOCALITY') THEN 'PARTIAL_MATCH' ELSE 'FAILED' END"
    items = [f"CASE WHEN NOT {p}{k} THEN '{k}: unconfirmed' END" for k in parts] + [f"'azure_score: ' || printf('%.3f', {s})", f"CASE WHEN {p}kind <> '' THEN 'azure_type: ' || {p}kind END", f"CASE WHEN {p}match <> '' THEN 'match_type: ' || {p}match END"]
    return c.add(**{
        f"{p}status": status, f"{p}gran": f"CASE WHEN {p}found THEN {g} ELSE 'NONE' END", f"{p}text": f"CASE WHEN {p}found THEN {p}raw ELSE '' END", f"{p}notes": f"CASE WHEN {p}found THEN list_filter([{', '.join(items)}], lambda x: x IS NOT NULL) ELSE ['address: no Azure Maps match'] END",
        f"{p}inferred": f"{p}found AND {p}inf", f"{p}replaced": f"{p}found AND {p}inf AND {p}match IN ('pointaddress', 'addressrange')", f"{p}loose": f"NOT {p}found OR {s} < 0.80 OR {g} IN ('LOCALITY', 'NONE', 'OTHER')",
    })


RECORDED = answered(
    PARSED.add(a="array_to_string([parsed_street, parsed_city, parsed_country], ', ')"), "a", "r_", "row_id % 17 > 0", "0.5::DOUBLE + row_id % 51 / 100", pick(["Point Address", "Street", "Geography", "Other"], "row_id"), pick(["PointAddress", "AddressRange", "", "Street", "Municipality"], "row_id // 2"),
    "CASE WHEN row_id % 3 = 0 THEN a ELSE '1 High Street, ' || parsed_city END", {"street_number": "CASE WHEN row_id % 2 = 0 THEN '12' ELSE '' END", "street_name": "CASE WHEN row_id % 5 > 0 THEN 'Main' ELSE '' END", "municipality": "parsed_city", "country_subdivision": "''", "postal_code": "'1'", "country": "'US'"},
)


def by_service(chain: Chain, a: str, p: str) -> Chain:
    """The service of ``q43``: its answer to ``a`` follows from the address; ``<p>err`` says that it failed."""
    k = f"{p}k"
    c = chain.add(**{k: f"('0x' || substr(md5({squeeze(strip(f'lower({a})'), 1)}), 1, 8))::BIGINT"})
    c = c.add(**{f"{p}err": f"CASE WHEN {a} IS NOT NULL AND {k} % 13 = 0 THEN 'Request timeout ' || ({k} % 3) END"})
    return answered(
        c, a, p, f"coalesce({k} % 13 > 0 AND {k} % 17 > 0, false)", f"0.5::DOUBLE + {k} % 51 / 100", pick(["Point Address", "Street", "Geography"], f"({k} // 7)"), pick(["PointAddress", "AddressRange", "", "Street"], f"({k} // 3)"),
        f"CASE WHEN {k} % 3 = 0 THEN {p}sent ELSE '1 High Street, Paris' END", {"street_number": f"CASE WHEN {k} % 2 = 0 THEN '12' ELSE '' END", "street_name": f"CASE WHEN {k} % 5 > 0 THEN 'Main' ELSE '' END", "municipality": "''", "country_subdivision": "''", "postal_code": "'1'", "country": "'US'"},
    )


def asked(chain: Chain, a: str, p: str) -> Chain:
    """Equal addresses are sent once, in the spelling of the first record."""
    same = f"{squeeze(strip(f'lower({a})'), 1)}, upper(suggested_country)"
    return by_service(chain.add(**{f"{p}sent": f"CASE WHEN {a} IS NOT NULL THEN first_value({a}) OVER (PARTITION BY {same}, {a} IS NULL ORDER BY row_id) END"}), a, p)


def live() -> Chain:
    skip = f"({strip('api_address')} = '' OR completeness_class = 'EMPTY')"
    c = asked(SECOND.add(ask=f"CASE WHEN NOT {skip} THEN api_address END"), "ask", "r_")
    c = c.add(open0="r_status NOT IN ('VALIDATED', 'CORRECTED', 'PARTIAL_VALIDATED') AND r_err IS NULL")
    blames = lambda w: f"(len(list_filter(r_notes, lambda x: contains(x, '{w}'))) > 0)"
    pieces = parts_of("api_address")
    short = rf"({blames('postal')} AND (regexp_matches({pieces}[-1], '^[\d\s-]{{3,10}}$') OR regexp_matches({pieces}[-1], '^[A-Z0-9\s]{{3,10}}$')))"
    kept = f"CASE WHEN {short} THEN array_to_string(list_slice({pieces}, 1, len({pieces}) - 1), ', ') ELSE api_address END"
    weak = f"({blames('street_number')} AND (NOT r_found OR round(r_s, 3) < 0.75))"
    fixed = rf"CASE WHEN {weak} THEN regexp_replace({kept}, '^\d+[-/]?\d*\s*', '') ELSE {kept} END"
    plain = rf"regexp_replace(regexp_replace(regexp_replace(api_address, '(?i),?\s*({t.UNIT_WORDS})\.?\s*\S*', '', 'g'), '\s*\([^)]*\)', '', 'g'), '\s*No\.?\s*\d+', '', 'g')"
    plain = strip(f"regexp_replace({strip(plain)}, ',+$', '')")
    wide = f"CASE WHEN len({pieces}) >= 3 THEN array_to_string(list_slice({pieces}, len({pieces}) - 2, len({pieces})), ', ') END"
    c = c.add(**{f"try{i}": f"nullif(nullif({e}, api_address), '')" for i, e in enumerate((fixed, plain, wide))})
    good = "('VALIDATED', 'CORRECTED', 'PARTIAL_VALIDATED')"
    for i in range(3):
        c = c.add(**{f"ask{i}": f"CASE WHEN open{i} AND {strip(f'coalesce(try{i}, {q(str())})')} <> '' THEN try{i} END"})
        c = asked(c, f"ask{i}", f"t{i}_")
        c = c.add(**{f"open{i + 1}": f"open{i} AND coalesce(t{i}_status NOT IN {good}, true)"})
    won = [f"(ask{i} IS NOT NULL AND t{i}_status IN {good})" for i in range(3)]
    made = [f"(try{i} IS NOT NULL)::INT" for i in range(3)]
    pick_ = lambda f, other: "CASE " + " ".join(f"WHEN {won[i]} THEN {f(i)}" for i in range(3)) + f" ELSE {other} END"
    c = c.add(
        k_status=pick_(lambda i: f"t{i}_status", "'FAILED'"), k_strategy=pick_(lambda i: ["'component_fix'", "'simplify_address'", "'broaden_search'"][i], "NULL"), k_attempts=pick_(lambda i: "(" + " + ".join(made[: i + 1]) + ")", "(" + " + ".join(made) + ")"),
        k_text=pick_(lambda i: f"t{i}_text", "NULL"), k_gran=pick_(lambda i: f"t{i}_gran", "NULL"),
        b=f"CASE WHEN {skip} THEN 'skip' WHEN r_err IS NOT NULL THEN 'error' WHEN r_status IN {good} THEN 'direct' ELSE 'try' END",
    )
    c = c.add(b2="CASE WHEN b <> 'try' THEN b WHEN k_status IN ('CORRECTED', 'PARTIAL_VALIDATED') THEN 'fixed' ELSE 'failed' END")
    has = lambda w: f"len(list_filter(r_notes, lambda x: contains(x, '{w}'))) > 0"
    r = t.FAILURE_REASONS
    said = rf"array_to_string(list_filter([CASE WHEN NOT regexp_matches(api_address, '\d') THEN {q(r['digit'])} END, CASE WHEN length({strip('api_address')}) < 10 THEN {q(r['short'])} END, CASE WHEN {has('unrecognized')} THEN {q(r['unrecognized'])} END, CASE WHEN {has('insufficient')} THEN {q(r['insufficient'])} END], lambda x: x IS NOT NULL), '; ')"
    return c.add(
        validation_status="CASE b2 WHEN 'skip' THEN 'SKIPPED' WHEN 'error' THEN 'API_ERROR' WHEN 'direct' THEN r_status WHEN 'fixed' THEN k_status ELSE 'FAILED' END", validated_address="CASE b2 WHEN 'direct' THEN r_text WHEN 'fixed' THEN k_text END",
        correction_status="CASE b2 WHEN 'direct' THEN CASE r_status WHEN 'CORRECTED' THEN 'API_CORRECTED' WHEN 'PARTIAL_VALIDATED' THEN 'API_PARTIAL' END WHEN 'fixed' THEN CASE k_status WHEN 'PARTIAL_VALIDATED' THEN 'ENGINE_PARTIAL' ELSE 'ENGINE_CORRECTED' END WHEN 'failed' THEN 'EXHAUSTED' END",
        correction_strategy="CASE b2 WHEN 'direct' THEN CASE r_status WHEN 'CORRECTED' THEN 'api_auto' WHEN 'PARTIAL_VALIDATED' THEN 'api_partial' END WHEN 'fixed' THEN k_strategy END", correction_attempts="CASE b2 WHEN 'direct' THEN CASE WHEN r_status = 'CORRECTED' THEN 1 ELSE 0 END WHEN 'fixed' THEN k_attempts WHEN 'failed' THEN k_attempts END",
        failure_reason=f"CASE b2 WHEN 'skip' THEN 'No usable address for API submission' WHEN 'error' THEN r_err WHEN 'failed' THEN CASE WHEN k_status = 'VALIDATED' THEN 'Unknown' ELSE coalesce(nullif({said}, ''), {q(r['none'])}) END END",
        manual_review_flag="b2 IN ('skip', 'error', 'failed')", validation_granularity="CASE b2 WHEN 'direct' THEN r_gran WHEN 'failed' THEN r_gran WHEN 'fixed' THEN k_gran END",
    )


LIVE = live()


def cascade() -> str:
    """The searches of ``q51``: scores of the one hit of each."""
    sim = lambda a, b: f"({similarity(a, b)})::DOUBLE"
    first = Chain("SELECT s_suppkey AS k, 'Acme ' || (s_suppkey % 7) || ' Tools Inc' AS co, (s_suppkey % 5) || ' Main Street' AS ad, (s_suppkey % 10) / 100 AS lat FROM supplier").add(
        n1="'ACME ' || (k % 3) || ' Tools GmbH'", a1="(k % 4) || ' main street'", l1="((k + k % 3) % 10) / 100", n2="'Other ' || (k % 3) || ' Shop'", a2="(k % 5) || ' main street'", l2="lat", n3="CASE WHEN k % 2 = 0 THEN 'ACME ' || (k % 7) || ' tools' ELSE 'Street' END"
    )
    for i in (1, 2):
        first = first.add(**{f"s{i}": sim("co", f"n{i}"), f"t{i}": sim("ad", f"a{i}"), f"d{i}": f"CASE WHEN abs(lat - l{i}) <= 0.001 THEN 1.0 WHEN abs(lat - l{i}) <= 0.01 THEN 0.75 WHEN abs(lat - l{i}) <= 0.05 THEN 0.45 ELSE 0.10 END::DOUBLE"})
        first = first.add(**{f"c{i}": f"round(0.45::DOUBLE * s{i} + 0.30::DOUBLE * t{i} + 0.20::DOUBLE * d{i} + 0.05::DOUBLE, 3)", f"s{i}r": f"round(s{i}, 3)", f"t{i}r": f"round(t{i}, 3)"})
        first = first.add(**{f"v{i}": f"CASE WHEN s{i}r >= 0.70 AND t{i}r >= 0.60 AND d{i} >= 0.75 THEN 'VERIFIED' WHEN s{i}r >= 0.45 AND t{i}r >= 0.45 AND d{i} >= 0.45 AND c{i} >= 0.50 THEN 'LIKELY_MATCH' WHEN t{i}r >= 0.55 AND d{i} >= 0.75 THEN 'ADDRESS_MISMATCH' ELSE 'UNVERIFIED' END"})
    first = first.add(s3=sim("co", "n3")).add(ok="k % 11 > 0 AND round(s3, 3) >= 0.45 AND n3 <> 'Street'", step="CASE WHEN v1 IN ('VERIFIED', 'LIKELY_MATCH') THEN 1 WHEN k % 3 > 0 AND v2 <> 'UNVERIFIED' THEN 2 ELSE 3 END")
    return first.select(
        "SELECT k AS row_id, CASE step WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE CASE WHEN ok THEN 'CORRECT_ADDRESS_CANDIDATE' ELSE 'UNVERIFIED' END END AS company_verification_status, CASE step WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE CASE WHEN ok THEN round(0.85::DOUBLE * s3 + 0.15::DOUBLE, 3) ELSE 0.0::DOUBLE END END AS verification_confidence, "
        "CASE step WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE CASE WHEN ok THEN n3 ELSE '' END END AS matched_company_name, CASE step WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE CASE WHEN ok THEN '9 Far Road' ELSE '' END END AS matched_address, CASE step WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE '' END AS occupant_at_address, "
        "(['azure_poi_name_near_address', 'azure_poi_address_occupant', 'azure_fuzzy_company_lookup'])[step] AS verification_method, CASE WHEN step = 3 AND k % 11 = 0 THEN 'down' END AS api_error FROM {in}"
    )


PARSED_CANDIDATES = """
WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 9 > 0),
h AS (SELECT k AS row_id, 0 AS ord, CASE WHEN k % 4 > 0 THEN 'ACME  ' || (k % 7) WHEN k % 8 > 0 THEN 'POI' ELSE '' END AS name, (k % 5) || ' main street' AS address, ((k % 10) / 100)::DOUBLE AS latitude, ((k % 11) / 10)::DOUBLE AS score, (['', 'shop', 'shop, office'])[k % 3 + 1] AS category FROM c
  UNION ALL SELECT k, 1, 'Second', '', NULL, 0.0, '' FROM c WHERE k % 2 = 0)
SELECT *, left(trim(regexp_replace(name || ' ' || address || ' ' || repeat('y ', 90), '\\s+', ' ', 'g')), 180) AS question FROM h
""".replace("\\\\", "\\")

ENRICHED = """
WITH e AS (SELECT event_id, event_id AS k, event_id % 3 < 2 AS trusted, event_id % 5 > 0 AS said, event_id % 7 > 0 AS json, event_id % 10 = 0 AS failed FROM events),
b AS (SELECT *, CASE WHEN trusted AND k % 4 > 0 THEN 'Acme Tools ' || (k % 5) ELSE 'Clean Name' END AS name, CASE WHEN trusted THEN '1 Main' ELSE 'V' END AS address, trusted AND said AND json AS good, trusted AND said AND NOT json AS bad FROM e)
SELECT event_id, CASE WHEN good THEN 'L' || (k % 3) ELSE name END AS legal_name, CASE WHEN good THEN 'w' || (k % 4) || '.com' ELSE '' END AS website, CASE WHEN good OR NOT trusted THEN '' WHEN k % 4 > 0 THEN 'acmetools' || (k % 5) || '.com' ELSE 'cleanname.com' END AS email_domain, '' AS naics_code,
  CASE WHEN good THEN '' ELSE address END AS headquarters_address, address AS enriched_full_address, CASE WHEN good THEN 'openai_assisted' ELSE 'deterministic_fallback' END AS enrichment_method,
  CASE WHEN trusted AND failed THEN 'OpenAI enrichment failed: HTTP 500: no' WHEN good THEN 'n' WHEN bad THEN 'OpenAI enrichment returned non-JSON content' WHEN trusted THEN 'Deterministic enrichment from verified company/address match.' ELSE 'Verification unresolved; firmographic enrichment held for manual review.' END AS enrichment_notes
FROM b
"""

WEB = """
WITH c AS (SELECT c_custkey AS row_id, 'Shop ' || (c_custkey % 40) AS name, c_custkey % 5 = 0 AS has, 'Shop ' || (c_custkey % 40) || ' 1 A St' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' Other' END AS question FROM customer),
asked AS (SELECT question, min(row_id) AS o FROM c WHERE NOT has GROUP BY 1 ORDER BY o LIMIT 30),
j AS (SELECT c.*, a.question IS NOT NULL AND length(c.question) % 3 > 0 AS hit, a.question IS NOT NULL AS sent FROM c LEFT JOIN asked a ON a.question = c.question AND NOT c.has)
SELECT row_id, has OR hit AS external_evidence_available, CASE WHEN hit THEN 'bing_web_search' ELSE '' END AS external_evidence_source, CASE WHEN hit THEN 'http://u/1' ELSE '' END AS external_evidence_url,
  CASE WHEN hit THEN 'name 0: about ' || length(question) || ' | name 1: about ' || length(question) || ' | name 2: about ' || length(question) ELSE '' END AS external_evidence_text FROM j
"""

_LANGS = ["en", "es", "de", "it", "pt", "fr", "zh"]
_args = tuple(f"parsed_{n}" for n in ("street", "city", "state", "country", "postal"))
_st = state("parsed_state", "upper(parsed_country)")
_po = postal("parsed_postal", "upper(parsed_country)")
FLAGS = "flag_no_street, flag_no_street_number, flag_no_city, flag_no_state, flag_no_postal, flag_garbled_text, flag_encoding_repaired, flag_complex_address, flag_name_has_codes, flag_non_latin"
COVERED = {"legal_name": "legal_name <> ''", "enriched_full_address": "enriched_full_address <> ''", "email_domain": "email_domain <> ''", "headquarters_address": "enriched_full_address <> ''"}

ORACLES: dict[str, str] = {
    "q01_tier_counts": counts(FIRST, "quality_tier", "quality_tier"),
    "q02_parse_composite": PARSED.select("SELECT row_id, parsed_street, parsed_city, parsed_state, parsed_country, parsed_postal FROM {in}"),
    "q03_name_clean": names(RAW).select("SELECT row_id, cleaned_name, array_to_string(name_removed_parts, '|') AS name_removed_parts, array_to_string(name_cleaning_actions, '|') AS name_cleaning_actions FROM {in}"),
    "q04_name_action_counts": unnested(names(RAW), "name_cleaning_actions"),
    "q05_encoding_repair": PARSED.select(f"SELECT row_id, {repaired('FULL_ADDRESS', MOJIBAKE)} AS FULL_ADDRESS, {repaired('parsed_street', MOJIBAKE)} AS parsed_street, contains(FULL_ADDRESS, 'CafÃ©') AS flag_encoding_repaired FROM {{in}}"),
    "q06_addr_normalize": addresses(PARSED).select("SELECT row_id, norm_street, norm_city, norm_state, norm_country, norm_postal, array_to_string(normalization_actions, '|') AS normalization_actions FROM {in}"),
    "q07_country_infer": PARSED.select(f"SELECT row_id, {gu(*_args, False, CODES, 'upper(parsed_country)')} AS country, {gu(*_args, False, REASONS, 'NULL')} AS reason FROM {{in}}"),
    "q08_lang_script": language(names(PARSED), False).select("SELECT row_id, detected_lang, lang_method FROM {in}"),
    "q09_lang_scorer": GUESS,
    "q10_quality_flags": FIRST.select(f"SELECT row_id, {FLAGS}, api_ready, needs_translation_1 AS needs_translation, quality_tier FROM {{in}}"),
    "q11_garble_ratio": f"SELECT doc_id, round({GARBLE.replace('{c}', 'text')}, 6) AS ratio, {GARBLE.replace('{c}', 'text')} > 0.1 AS garbled FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "q12_country_tier_crosstab": FIRST.select("SELECT parsed_country, " + ", ".join(f"count(*) FILTER (quality_tier = '{v}') AS {v}" for v in ("CRITICAL", "INCOMPLETE", "NEEDS_PREP", "READY")) + " FROM {in} GROUP BY 1"),
    "q13_abbrev_multilang": streets(PARSED.add(detected_lang=pick(_LANGS, "row_id // 3"), enhanced_street="parsed_street", **{LOG: "[]::VARCHAR[]"}), "enhanced_street", LOG).select(f"SELECT row_id, enhanced_street, array_to_string({LOG}, '|') AS {LOG} FROM {{in}}"),
    "q14_state_expand": PARSED.select(f"SELECT row_id, {_st[0]} AS state, {_st[1]} AS action FROM {{in}}"),
    "q15_postal_norm": PARSED.select(f"SELECT row_id, {_po[0]} AS postal, {_po[1]} AS action FROM {{in}}"),
    "q16_street_structure": structure(PARSED.add(enhanced_street="', ' || parsed_street || ' .'", **{LOG: "[]::VARCHAR[]"}), "enhanced_street", LOG).select(f"SELECT row_id, enhanced_street, array_to_string({LOG}, '|') AS {LOG} FROM {{in}}"),
    "q17_country_crossval": SECOND.select("SELECT row_id, country_validated, country_mismatch_reason, suggested_country FROM {in}"),
    "q18_completeness": SECOND.select("SELECT row_id, completeness_score, completeness_class, has_street, has_street_number, has_city, has_state, has_country, has_postal FROM {in}"),
    "q19_api_address": SECOND.select(f"SELECT row_id, api_address, api_strategy, needs_translation, translation_handling_status, translation_gap_reason, array_to_string({LOG}, '|') AS {LOG} FROM {{in}}"),
    "q20_sim_validate": SIM.select("SELECT row_id, r_status AS validation_status, r_text AS formatted_address, r_lat AS latitude, r_lon AS longitude, r_gran AS validation_granularity, array_to_string(r_notes, '|') AS diagnostics FROM {in}"),
    "q21_sim_correct": CORRECTED.select("SELECT row_id, k_status AS status, k_strategy AS strategy, k_attempts AS attempts FROM {in}"),
    "q22_validation_status": VALIDATED.select("SELECT row_id, validation_status, validated_address, correction_status, correction_strategy, correction_attempts, failure_reason, manual_review_flag, validation_granularity, array_to_string(validation_diagnostics, '|') AS validation_diagnostics FROM {in}"),
    "q23_dedupe_memo": simulated(
        SECOND.add(address="CASE WHEN row_id % 2 = 0 THEN lower(api_address) ELSE api_address END").add(k=f"{squeeze(strip('lower(address)'), 1)} || '|' || upper(suggested_country)").add(asked_address="first_value(address) OVER (PARTITION BY k ORDER BY row_id)", asked_country="first_value(suggested_country) OVER (PARTITION BY k ORDER BY row_id)"),
        "asked_address", "asked_country", "m_",
    ).select("SELECT row_id, asked_address, m_status AS validation_status FROM {in}"),
    "q24_country_breakdown": VALIDATED.select(f"SELECT norm_country, count(*) AS total, {OF('VALIDATED')} AS validated, {OF('CORRECTED')} AS corrected, {OF('PARTIAL_VALIDATED')} AS partial_validated, {OF('FAILED')} AS failed, {RATE.replace('{n}', EXACT)} AS exact_success_rate, {RATE.replace('{n}', USE)} AS usable_success_rate FROM {{in}} GROUP BY 1"),
    "q25_tier_completeness_breakdown": VALIDATED.select(rates("quality_tier") + " UNION ALL " + rates("completeness_class")),
    "q26_failure_reasons": counts(VALIDATED, "failure_reason", "failure_reason", "validation_status = 'FAILED'"),
    "q27_token_jaccard": f"SELECT a.p_brand, a.p_name, b.p_name AS other_name, count(*) AS n_pairs, round(any_value({similarity('a.p_name', 'b.p_name')}), 6)::DOUBLE AS similarity FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name < b.p_name GROUP BY ALL HAVING similarity > 0",
    "q28_candidate_argmax": SCORED + "SELECT s_suppkey, c_name, c_address, ord, name_score, address_score, distance_score, confidence FROM best",
    "q29_status_ladder": SCORED + f"SELECT s_suppkey, CASE WHEN {normal('c_name')} IN ({GENERIC}) OR length({normal('c_name')}) <= 2 THEN 'UNVERIFIED' WHEN name_score >= 0.70 AND address_score >= 0.60 AND distance_score >= 0.75 THEN 'VERIFIED' WHEN name_score >= 0.45 AND address_score >= 0.45 AND distance_score >= 0.45 AND confidence >= 0.50 THEN 'LIKELY_MATCH' WHEN address_score >= 0.55 AND distance_score >= 0.75 THEN 'ADDRESS_MISMATCH' ELSE 'UNVERIFIED' END AS status FROM best",
    "q30_evidence_lookup": EVIDENCE,
    "q31_sim_verify": THIRD.select("SELECT row_id, v_status AS status, v_conf AS confidence, CASE WHEN v_status = 'LIKELY_MATCH' THEN cleaned_name ELSE '' END AS matched_company_name FROM {in}"),
    "q32_adjudicate_replay": ADJUDICATED + "SELECT * FROM a",
    "q33_enrich_det": THIRD.select("SELECT row_id, legal_name, enriched_full_address, email_domain, enriched_full_address AS headquarters_address, 'deterministic_fallback' AS enrichment_method, CASE WHEN v_status = 'LIKELY_MATCH' THEN 'Deterministic enrichment from verified company/address match.' ELSE 'Verification unresolved; firmographic enrichment held for manual review.' END AS enrichment_notes FROM {in}"),
    "q34_routing": ADJUDICATED + "SELECT CASE WHEN final_company_verification_status IN ('VERIFIED', 'LIKELY_MATCH') THEN 'AUTO_ENRICH/NONE/false' WHEN final_company_verification_status = 'ADDRESS_MISMATCH' AND overall_confidence_score >= 0.75 THEN 'AUTO_NO_ENRICH_ADDRESS_MISMATCH/NONE/false' WHEN final_company_verification_status = 'ADDRESS_MISMATCH' THEN 'REVIEW_LOW_CONFIDENCE_MISMATCH/MEDIUM/true' WHEN final_company_verification_status = 'CORRECT_ADDRESS_CANDIDATE' THEN 'REVIEW_CORRECT_ADDRESS_CANDIDATE/HIGH/true' ELSE 'DEFER_NO_EVIDENCE/LOW/false' END AS route, count(*) AS n FROM a GROUP BY 1",
    "q35_field_coverage": THIRD.select(" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER ({COVERED.get(f, 'false')}) AS n FROM {{in}}" for f in t.COVERAGE_FIELDS)),
    "q36_confidence_mean": THIRD.select("SELECT round(avg(v_conf), 3) AS average_overall_confidence FROM {in}"),
    "q37_top_problem_rows": FIRST.select("SELECT row_id, MDM_KEY, SOURCE_NAME, cleaned_name, norm_street, quality_tier FROM {in} WHERE quality_tier IN ('CRITICAL', 'INCOMPLETE') ORDER BY row_id LIMIT 10"),
    "q38_sample10": "SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS rn, count(*) OVER () AS n FROM customer) WHERE rn <= floor(n * 0.1)",
    "q39_funnel": VALIDATED.select(f"SELECT count(*) AS total, {OF('VALIDATED')} AS validated, {OF('CORRECTED')} AS corrected, {OF('PARTIAL_VALIDATED')} AS partial_validated, {OF('FAILED')} AS failed, {OF('SKIPPED')} AS skipped, {USE} AS success, count(*) FILTER (manual_review_flag) AS manual_review FROM {{in}}"),
    "q40_answer_parse_replay": RECORDED.select("SELECT row_id, r_status AS validation_status, r_gran AS validation_granularity, r_text AS formatted_address, r_loose AS has_unconfirmed, r_inferred AS has_inferred, r_replaced AS has_replaced, array_to_string(r_notes, '|') AS diagnostics FROM {in}"),
    "q41_action_explode_norm": unnested(FIRST, "normalization_actions"),
    "q42_subset_sinks": THIRD.select(
        "SELECT 'api_ready' AS subset, count(*) FILTER (api_ready) AS n FROM F UNION ALL SELECT 'critical', count(*) FILTER (quality_tier = 'CRITICAL') FROM F UNION ALL SELECT 'coded_names', count(*) FILTER (flag_name_has_codes) FROM F UNION ALL "
        f"SELECT 'usable', {USE} FROM V UNION ALL SELECT 'manual_review', count(*) FILTER (manual_review_flag) FROM V UNION ALL SELECT 'attempted', count(correction_status) FROM V UNION ALL "
        "SELECT 'trusted', count(*) FILTER (v_status = 'LIKELY_MATCH') FROM {in} UNION ALL SELECT 'review', count(*) FILTER (review_routing LIKE 'REVIEW_%') FROM {in} UNION ALL SELECT 'deferred', count(*) FILTER (review_routing = 'DEFER_NO_EVIDENCE') FROM {in}".replace("F ", "F ")
    ).replace(" FROM F", f" FROM {FIRST.last}").replace(" FROM V", f" FROM {VALIDATED.last}"),
    "q43_service_replay": LIVE.select("SELECT row_id, validation_status, validated_address, correction_status, correction_strategy, coalesce(correction_attempts, -1) AS correction_attempts, failure_reason, manual_review_flag, validation_granularity FROM {in}"),
    "q44_modified": FIRST.select(f"SELECT count(*) AS total, count(*) FILTER ({strip('SOURCE_NAME')} <> cleaned_name) AS names_modified, round(100 * count(*) FILTER ({strip('SOURCE_NAME')} <> cleaned_name) / greatest(count(*), 1), 1) AS names_pct, count(*) FILTER (len(normalization_actions) > 0) AS addresses_modified, round(100 * count(*) FILTER (len(normalization_actions) > 0) / greatest(count(*), 1), 1) AS addresses_pct FROM {{in}}"),
    "q45_counts_of_missing": VALIDATED.select("SELECT 'drop' AS mode, correction_status AS value, count(*) AS n FROM {in} WHERE correction_status IS NOT NULL GROUP BY 2 UNION ALL SELECT 'keep', correction_status, count(*) FROM {in} GROUP BY 2 UNION ALL SELECT 'fill', coalesce(correction_status, 'N/A'), count(*) FROM {in} GROUP BY 2"),
    "q46_success_summary": VALIDATED.select(f"SELECT {EXACT} AS exact_success, {RATE.replace('{n}', EXACT)} AS exact_success_rate, {USE} AS usable_success, {RATE.replace('{n}', USE)} AS usable_success_rate, {OF('PARTIAL_VALIDATED')} AS partial_validated FROM {{in}}"),
    "q47_distinct_values": VALIDATED.select("SELECT DISTINCT correction_strategy FROM {in}"),
    "q48_truthy_text": SECOND.select("SELECT 'needs_translation' AS column_name, count(*) FILTER (needs_translation) AS n FROM {in} UNION ALL SELECT 'api_ready', count(*) FILTER (api_ready) FROM {in}"),
    "q49_run_counters": LIVE.select(f"SELECT count(*) AS total, {OF('VALIDATED')} AS validated, {OF('CORRECTED')} AS corrected, {OF('PARTIAL_VALIDATED')} AS partial, {OF('FAILED')} AS failed, {OF('API_ERROR')} AS errors, {OF('SKIPPED')} AS skipped, coalesce(sum(correction_attempts), 0)::BIGINT AS attempts, count(*) FILTER (correction_status IN ('ENGINE_CORRECTED', 'ENGINE_PARTIAL')) AS engine_successes FROM {{in}}"),
    "q50_candidate_parse": PARSED_CANDIDATES,
    "q51_search_cascade": cascade(),
    "q52_enrich_replay": ENRICHED,
    "q53_web_evidence": WEB,
    "q54_funnel_exact": VALIDATED.select(f"SELECT count(*) AS total, {OF('VALIDATED')} AS validated, {OF('CORRECTED')} AS corrected, {OF('PARTIAL_VALIDATED')} AS partial_validated, {OF('FAILED')} AS failed, {OF('SKIPPED')} AS skipped, {EXACT} AS success, count(*) FILTER (manual_review_flag) AS manual_review, (SELECT count(*) FROM (SELECT * FROM {{in}} ORDER BY row_id LIMIT 100) WHERE validation_status IN ('VALIDATED', 'CORRECTED', 'PARTIAL_VALIDATED')) AS usable_of_first_100 FROM {{in}}"),
}
