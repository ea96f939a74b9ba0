"""SQL (DuckDB) for the queries. It takes nothing from the code that it is held against: patterns, word lists and forms are written out here."""

from __future__ import annotations

TOKEN = r"[_\p{L}\p{N}]+"
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# French stop words.
_STOPS = """
au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui
sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant étante étants étantes suis es est sommes
êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois
soit soyons soyez soient fusse fusses fût fussions fussiez fussent ayant ayante ayantes ayants eu eue eues eus ai as avons avez ont aurai auras aura
aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse
eusses eût eussions eussiez eussent
"""
_NOUNS = """
article banc base batterie bulletin calculateur capteur catalyseur centre chaîne chercheur composite couche culture dispositif donnée drone équipe
étude fibre filière filtre ingénieur laboratoire laser lentille logiciel machine matériau membrane mesure méthode microscope module molécule moteur
mousse pile plateforme polymère prix procédé programme projet protéine protocole prototype puce réacteur recherche réseau résine robot satellite
simulation sonde spécialiste station structure surface système technique technologie traitement turbine vaccin véhicule
"""
_ADJECTIVES = """
autonome chimique durable fiable flexible hybride magnétique mobile numérique optique rapide recyclable réversible robuste sensible souple stable
thermique
"""
_VERBS = """
accélérer améliorer analyser compléter contrôler détecter espérer exploiter favoriser identifier limiter optimiser prolonger protéger recycler
remplacer simuler stabiliser transformer
"""
NBSP = "\xa0"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _latest(table: str, key: str, ties: str, name: str) -> str:
    return f"{name} as (select * from (select *, row_number() over (partition by {key} order by loaded_at desc nulls last{ties}) rn from {table} where {key} is not null) where rn = 1)"


_TIES = "".join(f", {c} desc nulls last" for c in "auteur bulletin contacts date rubrique texte titre".split())
DOCS = _latest("corpus", "article", _TIES, "docs")
PAGES = _latest("bulletins", "path", ", html desc nulls last", "pages")
TOKS = f"""{DOCS}, lists as (select article, regexp_extract_all(lower(concat_ws(' ', titre, texte)), '{TOKEN}') l from docs),
toks as (select article, (generate_subscripts(l, 1) - 1)::int pos, unnest(l) token from lists)"""
TF = f"{TOKS}, tf as (select article, token, count(*)::bigint tf from toks group by all)"
IDF = f"{TF}, idf as (select token, count(*)::bigint df, round(log10((select count(distinct article) from tf) / count(*)), 4) idf from tf group by token)"
W = f"{IDF}, tfidf as (select article, token, tf * idf w from tf join idf using (token))"
STOP = f"{W}, stop as (select distinct token from tfidf where w < 0.5 or w > 20)"
RULES = "rules as (select word, coalesce(arg_max(coalesce(replacement, ''), line_no), '') replacement from substitutions where word is not null group by word)"
STORED = f"""stored as (select article, pos, min(t) token from (select article, pos, nullif(lower({strip("token")}), '') t from tokens)
where t is not null and article is not null group by article, pos)"""


def _rewritten(x: str) -> str:
    """The field x of docs rewritten under a one-row map m of the rules."""
    toks = f"regexp_extract_all(lower({x}), '{TOKEN}')"
    return f"array_to_string(list_filter(list_transform({toks}, lambda t: coalesce(m[t], t)), lambda t: t <> ''), ' ')"


def _pairs(legend: str) -> str:
    return f"array_to_string(list_transform(images.image, lambda i: concat_ws('|', coalesce(i.urlimage, ''), coalesce({legend}, ''))), ';')"


IMAGES = _pairs("i.legendeimage")
_MAP = "m as (select map(list(word), list(replacement)) m from {})"
ALPHA = rf"""{DOCS}, ws as (select article, list_filter(regexp_split_to_array({strip("concat_ws(' ', titre, texte)")}, '{WS}+'), lambda w: w <> '') l from docs),
words as (select article, (generate_subscripts(l, 1) - 1)::int pos, unnest(l) word from ws), alpha as (select * from words where regexp_full_match(word, '\p{{L}}+'))"""


def _forms(words: str, ends: str, cut: int = 0) -> str:
    """Rows (form, lemma) of the words with each ending."""
    return ", ".join(f"('{w[: len(w) - cut]}{e}', '{w}')" for w in words.split() for e in ends.split(","))


_LEX = "lex(word, lemma) as (select word, min(lemma) from (values " + ", ".join((_forms(_NOUNS, ",s"), _forms(_ADJECTIVES, ",s,e,es"), _forms(_VERBS, "er,e,es,ons,ez,ent,ait,aient,era,eront,é,ée,és,ées,ant", 2))) + ") v(word, lemma) group by word)"
LEMMAS = f"{ALPHA}, {_LEX}, lemmas as (select article, pos, a.word, coalesce(lemma, lower(a.word)) reduction from alpha a left join lex on lower(a.word) = lex.word)"



def _unescape(x: str) -> str:
    """The entities that the test pages use."""
    for a, b in (("&nbsp;", NBSP), ("&eacute;", "é"), ("&gt;", ">"), ("&lt;", "<"), ("&#x27;", "''"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_TITLE = _unescape("regexp_extract(html, '<title>(.*?)</title>', 1)")
_SPANS = f"list_transform(regexp_extract_all(html, '(?s)<span[^>]*>(.*?)</span>', 1), lambda x: {_unescape('x')})"
_PART = lambda k: strip(f"string_split(title, '>')[{k}]")


def _after(labels: str) -> str:
    return f"spans[list_position(list_transform(spans, lambda x: {strip('x')} in ({labels})), true) + 1]"


def _author(line: str) -> str:
    parts = f"list_transform(string_split({line}, '-'), lambda x: {strip('x')})"
    return f"case when len({parts}) > 2 then ({parts})[2] || '-' || ({parts})[3] end"


_A = _after("'Rédacteur :', 'Rédacteurs :'")
_C = _after("'Pour en savoir plus, contacts :', 'Rédacteurs :Pour en savoir plus, contact :'")
PARSED = f"""{PAGES}, raw as (select path, html, {_TITLE} title, {_SPANS} spans, texte, regexp_extract(path, '([^/]+)\\.[^./]+$', 1) article from pages),
cut as (select *, {_A} author_line, {_C} contact_line from raw),
page as (select article, {_PART(1)} date, {strip("string_split(replace(title, '" + NBSP + "', ' '), '>')[1]")} date_nbsp,
regexp_split_to_array({_PART(2)}, '{WS}+')[-1] bulletin, {_PART(3)} titre, spans[46] rubrique,
array_to_string(list_transform(list_reverse(string_split(texte, chr(10))), lambda t: t || ' '), '') texte, texte texte_in_order,
{_author("author_line")} auteur, contact_line contacts, {_author("contact_line")} contact_auteur,
regexp_extract_all(html, '<meta [^>]*content="([^"]*)"', 1)[7] meta, spans, texte is null failed from cut)"""


def _images() -> str:
    """Images of the content cell; of an article with a block that lacks an image, none."""
    cell = "regexp_extract(html, '(?s)<tr><td><table>(.*?)</table>', 1)"
    src = "nullif(regexp_extract(b, '<img [^>]*src=\"([^\"]*)\"', 1), '')"
    legend = _unescape("regexp_extract(b, '(?s)<span[^>]*>(.*?)</span>', 1)")
    return f"""with {PARSED}, blocks as (select article, regexp_extract_all({cell}, '(?s)<div>(.*?)</div>', 1) l from raw),
whole as (select article, l from blocks where len(list_filter(l, lambda b: not regexp_matches(b, '<img ') or not regexp_matches(b, '<span'))) = 0),
rows as (select article, (generate_subscripts(l, 1) - 1)::int pos, unnest(l) b from whole) select article, pos, {src} urlimage, {legend} legendeimage from rows"""


def _documents() -> str:
    """Whole documents of the pages, images as text."""
    rows, _, last = _images().rpartition(" select article, pos,")
    joined = "string_agg(coalesce(" + last.split(" urlimage,")[0].strip() + ", '') || '|' || coalesce(" + last.split(" urlimage,")[1].rpartition(" legendeimage")[0].strip() + ", ''), ';' order by pos)"
    return f"""{rows}, pics as (select article, {joined} images from rows group by article)
select date, bulletin, article, titre, rubrique, texte, auteur, contacts, images, failed from page left join pics using (article)"""


def _xml() -> str:
    esc = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    tag = lambda t, x: f"coalesce('<{t}>' || {esc(x)} || '</{t}>', '')"
    body = " || ".join(tag(c, c) for c in "date bulletin article titre rubrique texte auteur".split())
    one = f"'<image>' || {tag('urlImage', 'i.urlimage')} || {tag('legendeImage', 'i.legendeimage')} || '</image>'"
    pics = f"case when len(images.image) > 0 then '<images>' || array_to_string(list_transform(images.image, lambda i: {one}), '') || '</images>' else '' end"
    return f"with {DOCS} select article, '<document>' || {body} || {pics} || {tag('contacts', 'contacts')} || '</document>' xml from docs"


def _useful() -> str:
    values = ", ".join("('" + w.replace("'", "''") + "')" for w in _STOPS.split())
    return f"with {LEMMAS}, stops(word) as (values {values}) select article, pos, word, reduction from lemmas where lower(word) not in (select word from stops)"


_REPORT = "select count(reduction)::bigint total, count(distinct reduction)::bigint uniques, round((1 - count(distinct reduction) / nullif(count(reduction), 0)) * 100, 2) taux from"


_TEXTS = "date bulletin article titre rubrique texte auteur contacts".split()


def _readable(rows: str, names: list[str] = _TEXTS) -> str:
    """Empty fields as missing ones, which files can't tell apart."""
    return f"select {', '.join(f"nullif({c}, '') as {c}" for c in names)} from ({rows})"


def build() -> dict[str, str]:
    page = lambda c, name=None: f"with {PARSED} select article, {c}{' as ' + name if name else ''} from page"
    fields = [f"case when {f} is not null then {_rewritten(f)} end" for f in ("titre", "rubrique", "texte")]
    legend = f"case when i.legendeimage is not null then {_rewritten('i.legendeimage')} end"
    filtered = f"select date, bulletin, article, {fields[0]} titre, {fields[1]} rubrique, {fields[2]} texte, auteur, contacts, {_pairs(legend)} images from docs, m"
    stopped = f"with {STOP}, rules as (select token word, '' replacement from stop), {_MAP.format('rules')} {filtered}"
    return {
        "file_pages": f"with {PAGES} select regexp_extract(path, '([^/]+)\\.[^./]+$', 1) article, html from pages where html is not null",
        "file_tokens": f"with {TOKS} select * from toks",
        "file_tf": f"with {TF} select * from tf",
        "file_tf_padded": f"with {TF} select * from tf",
        "file_idf": f"with {IDF} select * from idf",
        "file_tfidf_padded": f"with {W} select * from tfidf",
        "file_stop_lines": f"with {STOP} select token word, null::varchar replacement from stop",
        "file_substitutions": f"with {RULES} select * from rules",
        "file_corpus": f"with {DOCS} {_readable('select * from docs')}",
        "file_corpus_tolerant": f"with {DOCS} {_readable('select * from docs')}",
        "file_corpus_filtered": _readable(stopped),
        "file_subcorpus": f"with {DOCS} {_readable('select * from docs', ['article', 'titre'])}",
        "corpus_one_file": f"with {DOCS} select 1::bigint files, count(*)::bigint as lines from docs",
        "posting_blocks": f"with {TF} select token, article from tf",
        "tokens": f"with {TOKS} select * from toks",
        "token_counts_per_doc": f"with {TOKS} select article, len(l)::int n_tokens from lists",
        "stored_tokens": f"with {STORED} select * from stored",
        "whitespace_words": f"with {DOCS}, w as (select article, list_filter(regexp_split_to_array({strip("concat_ws(' ', titre, texte)")}, '{WS}+'), lambda w: w <> '') l from docs) select article, (generate_subscripts(l, 1) - 1)::int pos, unnest(l) word from w",
        "alpha_words": f"with {ALPHA} select * from alpha",
        "tf": f"with {TF} select * from tf",
        "stored_tf": f"with {STORED} select article, token, count(*)::bigint tf from stored group by all",
        "doc_count": f"with {TF} select count(distinct article)::bigint n from tf",
        "df": f"with {IDF} select token, df from idf",
        "idf": f"with {IDF} select * from idf",
        "idf_raw": f"with {TF} select token, count(*)::bigint df, round(log10((select count(distinct article) from tf) / count(*)), 10) idf from tf group by token",
        "tfidf": f"with {W} select * from tfidf",
        "tfidf_by_token": f"with {W} select token, article, w from tfidf",
        "tfidf_band_counts": f"with {W} select count(*)::bigint n, (count(*) filter (w > 10))::bigint above_10, (count(*) filter (w > 20))::bigint above_20, (count(*) filter (w < 0.5))::bigint below_half from tfidf",
        "out_of_band": f"with {W} select * from tfidf where w < 0.5 or w > 20",
        "postings": f"with {TF} select token, string_agg(article, ' ' order by article) articles from tf group by token",
        "forward_index": f"with {TOKS} select article, string_agg(token, ' ' order by pos) tokens from toks group by article",
        "series_all": f"with {W} select token, arg_max(w, article) w from tfidf where w > 20 group by token",
        "series_doc": f"with {W} select token, w from tfidf where article = (select min(article) from docs)",
        "antidictionary": f"with {STOP} select token from stop",
        "stop_filter": f"with {STOP} select article, pos, token from toks where token not in (select token from stop)",
        "substitution_rules": f"with {RULES} select * from rules",
        "substitute_words": f"with {DOCS}, {RULES}, {_MAP.format('rules')} select article, {fields[2]} texte from docs, m",
        "corpus_filtered": f"with {STOP}, rules as (select token word, '' replacement from stop), {_MAP.format('rules')} {filtered}",
        "corpus_substituted": f"with {DOCS}, {RULES}, {_MAP.format('rules')} select article, titre, rubrique, texte, images from ({filtered})",
        "subcorpus_titre": f"with {DOCS} select article, titre from docs",
        "subcorpus_rubrique": f"with {DOCS} select article, rubrique from docs",
        "page_date": page("date"),
        "page_date_nbsp": page("date_nbsp", "date"),
        "page_titre": page("titre"),
        "page_bulletin": page("bulletin"),
        "article_stem": f"with {PAGES} select path, regexp_extract(path, '([^/]+)\\.[^./]+$', 1) article from pages",
        "page_rubrique": page("rubrique"),
        "page_texte": page("texte"),
        "page_texte_in_order": page("texte_in_order", "texte"),
        "page_auteur": page("auteur"),
        "page_meta_auteur": page("meta", "auteur"),
        "page_images": _images(),
        "page_documents": _documents(),
        "page_contacts": page("contacts"),
        "page_contact_auteur": page("contact_auteur", "auteur"),
        "page_spans": f"with {PARSED} select article, (generate_subscripts(spans, 1) - 1)::int pos, unnest(spans) as text from page",
        "corpus_document": f"with {DOCS} select date, bulletin, article, titre, rubrique, texte, auteur, contacts, {IMAGES} images from docs",
        "corpus_images": f"with {DOCS}, i as (select article, images.image l from docs), f as (select article, (generate_subscripts(l, 1) - 1)::int pos, unnest(l) x from i) select article, pos, x.urlimage, x.legendeimage from f",
        "corpus_xml": _xml(),
        "lemma_dict": f"with {LEMMAS} select * from lemmas",
        "useful_words": _useful(),
        "vocab_report": f"with {LEMMAS} {_REPORT} lemmas",
        "vocab_distribution": f"with {LEMMAS} select reduction, count(*)::bigint freq from lemmas group by reduction",
    }
