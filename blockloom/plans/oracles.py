"""DuckDB twins of the engine's queries over the fixtures' English rule set, composed of named steps."""

from __future__ import annotations

from ..sources.adapters import INLINE_PATTERN, PAGE_PATTERN
from ..sources.rules import DEEP_STYLES, LINE_STYLES, TAG_STYLES, ZONES

NON = r"[^\p{L}\p{N}_]"
NUMBER = r"[0-9]+(?:\.[0-9]+){0,5}"
LETTER = "[А-ЯA-Z]"
ROOT = rf"(?i)^\s*Appendix\s+{LETTER}(?:\s*\([^)]*\))?(?:\s*[—:-]\s*.+|\s+.+)?$"
SUB = rf"^\s*{LETTER}(?:\.[0-9]+){{1,5}}\s+.+$"
W = "WINDOW w AS (PARTITION BY document_id ORDER BY block_order), f AS (PARTITION BY document_id ORDER BY block_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def strip(x: str, chars: str = r"\s ") -> str:
    return f"regexp_replace({x}, '^[{chars}]+|[{chars}]+$', '', 'g')"


def lines_sql() -> dict[str, str]:
    styles = ["'Heading 1'", "'Normal'", "'Normal'", "'List dash'", "'List dash'", "'Heading 2'", "'Note label'", "'Note text'", "'Table caption'", "'Normal'", "NULL", "'Figure'", "'Body X'", "'Heading X'", "'For deletion'", "CASE WHEN document_id % 3 = 0 THEN 'Heading 1' ELSE 'Normal' END"]
    texts = ["num || ' ' || head", "line", "line || ':'", "'- ' || line", "'- ' || line || ';'", "num || '.1 ' || head", "'Note'", "line", "'Table ' || num || ' ' || head", "''", "NULL", "'Table ' || num", "line", "head", "line", "CASE WHEN document_id % 3 = 0 THEN 'Appendix A' ELSE line END"]
    pick = lambda xs: "CASE k " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    return {
        "cut": "SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents",
        "numbered": "SELECT *, (document_id * 7 + pos) % 16 AS k, CAST(pos // 16 + 1 AS VARCHAR) AS num, substr(line, 1, 24) AS head FROM cut",
        "blocks": f"""SELECT document_id, CAST(pos + 1 AS BIGINT) AS block_order, CASE WHEN k = 10 THEN 'table' ELSE 'paragraph' END AS kind, {pick(styles)} AS style, {pick(texts)} AS text,
            CAST(CASE WHEN k = 10 AND document_id % 3 <> 0 THEN 1 END AS BIGINT) AS table_rows, CAST(CASE WHEN k = 10 AND document_id % 3 = 1 THEN 2 END AS BIGINT) AS table_cols FROM numbered""",
    }


def pages_sql() -> dict[str, str]:
    p = PAGE_PATTERN.replace("'", "''")
    found = [f"regexp_extract_all(regexp_replace(html, '{INLINE_PATTERN}', '', 'g'), '{p}', {i})" for i in (1, 2)]
    return {"blocks": f"SELECT page_id AS document_id, CAST(generate_subscripts({found[0]}, 1) AS BIGINT) AS block_order, 'paragraph' AS kind, unnest({found[0]}) AS style, unnest({found[1]}) AS text, CAST(NULL AS BIGINT) AS table_rows, CAST(NULL AS BIGINT) AS table_cols FROM pages"}


def deep_sql() -> dict[str, str]:
    styles = [*["'Heading ' || CAST(1 + (pos * 7 + document_id) % 15 AS VARCHAR)"] * 5, "'Title line'", "'Title line'", "'Cover'", "'Structural, not in contents'", "'Heading Title'", "'Normal'", "'Appendix head'", "'Normal'", "NULL", "'Meta'", "'Normal'"]
    texts = [*["'Part ' || CAST(pos AS VARCHAR)"] * 5, "line", "'Bibliography'", "line", "'The control sheet'", "'Part ' || CAST(pos AS VARCHAR)", "'Contents'", "'Appendix B'", "'Bibliography'", "line", "line", "line"]
    pick = lambda xs: "CASE k " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    return {
        "cut": lines_sql()["cut"],
        "numbered": "SELECT *, CASE WHEN pos % 40 = 39 AND document_id % 2 = 0 THEN 11 WHEN pos % 9 < 2 THEN (document_id * 7 + pos * pos + pos * (document_id % 5)) % 16 ELSE (document_id + pos) % 5 END AS k FROM cut",
        "blocks": f"SELECT document_id, CAST(pos + 1 AS BIGINT) AS block_order, 'paragraph' AS kind, {pick(styles)} AS style, {pick(texts)} AS text, CAST(NULL AS BIGINT) AS table_rows, CAST(NULL AS BIGINT) AS table_cols FROM numbered",
    }


def quoted(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "'" + ",".join(x) + "'"
    return f"'{x}'" if isinstance(x, str) else str(x)


def rules_sql(rows: list[tuple]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ") AS r(style, rt, rs, rz, rl, rlist, rlevel, rflags)"


def block_text(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(coalesce({x}, ''), '[ \t]', ' ', 'g'), ' {{2,}}', ' ', 'g')")


def zones_sql() -> dict[str, str]:
    """Zones before (zb) and after (za) each block: the maps of b5t applied one after the other."""
    letters = [chr(97 + i) for i in range(len(ZONES))]
    target = "CASE tz " + " ".join(f"WHEN '{z}' THEN '{x}'" for z, x in zip(ZONES, letters, strict=True)) + " END"
    body = {"control_sheet": "power >= 2", "toc": "power = 4", "main_body": "power = 4", "appendix": "power >= 1", "bibliography": "power >= 2"}
    after = [f"CASE WHEN {body[z]} THEN '{x}' ELSE {target} END" if z in body else f"CASE WHEN titled THEN 'a' WHEN power >= {3 if z == 'title_page' else 4} THEN '{x}' ELSE {target} END" for z, x in zip(ZONES, letters, strict=True)]
    name = lambda x: f"CASE {x} " + " ".join(f"WHEN '{c}' THEN '{z}'" for z, c in zip(ZONES, letters, strict=True)) + " END"
    return {
        "zm": f"SELECT *, {' || '.join(after)} AS zmap, row_number() OVER w AS rn FROM b5t {W}",
        "zs": "SELECT document_id, list_reduce(list_prepend('a', list(zmap ORDER BY block_order)), lambda s, x: s || substr(x, ascii(right(s, 1)) - 96, 1)) AS states FROM zm GROUP BY document_id",
        "b11": f"SELECT zm.* EXCLUDE (zmap, rn), {name('substr(states, rn, 1)')} AS zb, {name('substr(states, rn + 1, 1)')} AS za FROM zm JOIN zs USING (document_id)",
    }


def analysis_sql(source: dict[str, str], rules: list[tuple]) -> dict[str, str]:
    words = r"len(regexp_extract_all(norm, '[\p{L}\p{N}_-]+'))"
    tops = lambda name, opens, ident: ", ".join(f"last_value(CASE WHEN {opens} AND lvl <= {k} THEN {{'lvl': lvl, 'id': {ident}, 'title': ttl}} END IGNORE NULLS) OVER f AS {name}{k}" for k in range(1, 10))
    stack = lambda name: "list_filter([" + ", ".join(f"CASE WHEN {name}{k}.lvl = {k} THEN {name}{k} END" for k in range(1, 10)) + "], lambda x: x IS NOT NULL)"
    kind_of = lambda guess: f"CASE WHEN rt IN ('paragraph', 'heading') THEN coalesce({guess}, rt) WHEN rt IS NOT NULL THEN rt ELSE coalesce({guess}, CASE WHEN numb THEN 'heading' END, 'paragraph') END"
    own_number = rf"nullif(regexp_extract(norm, '^\s*({NUMBER})(?:{NON}|$)', 1), '')"
    letter = rf"nullif(regexp_extract(norm, '^\s*({LETTER}(?:\.[0-9]+){{0,5}})(?:{NON}|$)', 1), '')"
    after_number = rf"coalesce(nullif(regexp_extract(norm, '^\s*{NUMBER}\s+(.+)$', 1), ''), norm)"
    root_title = rf"(?i)^\s*Appendix\s+{LETTER}\s*(.+)?$"
    return {
        **source,
        "rules": rules_sql(rules),
        "b0": f"SELECT document_id, block_order, kind, table_rows, table_cols, {strip("coalesce(style, '')")} AS style, text, {block_text('text')} AS norm FROM blocks",
        "b1": rf"""SELECT b0.*, rt, rs, rz, rl, rlist, rlevel, rflags, kind = 'table' AS tab, kind <> 'table' AND norm = '' AS emp, lower(b0.style) AS ls,
            contains(lower(b0.style), 'heading') AND NOT (contains(lower(b0.style), 'table') OR contains(lower(b0.style), 'figure') OR contains(lower(b0.style), 'contents')) AS hs,
            regexp_matches(norm, '{ROOT}') AS isroot, regexp_matches(norm, '{SUB}') AS issub, regexp_matches(norm, '^\s*{NUMBER}\s+.+$') AS numb,
            regexp_matches(norm, '[.!?;:]$') AS term, {words} AS nw
            FROM b0 LEFT JOIN rules ON b0.style = rules.style""",
        "b2": "SELECT *, isroot OR issub OR numb OR (NOT term AND NOT regexp_matches(norm, '[,;]') AND nw BETWEEN 1 AND 8 AND length(norm) <= 80) AS shape, (hs AND contains(ls, 'appendix')) OR isroot AS sure FROM b1",
        "b3": f"""SELECT *, {kind_of("CASE WHEN sure OR issub OR (hs AND (shape OR (starts_with(norm, '(') AND nw <= 8 AND NOT term))) THEN 'appendix_heading' WHEN hs AND shape THEN 'heading' END")} AS it,
            {kind_of("CASE WHEN sure THEN 'appendix_heading' WHEN hs AND shape THEN 'heading' END")} AS ot FROM b2""",
        "b4": """SELECT *, ot = 'appendix_heading' OR isroot OR issub AS always, coalesce(rz, 'main_body') AS dz,
            CASE WHEN lower(norm) = 'control sheet' OR (contains(lower(norm), 'control sheet') AND contains(ls, 'structural') AND contains(ls, 'not in contents')) THEN 'control_sheet' WHEN lower(norm) = 'contents' OR contains(ls, 'contents') OR ot = 'toc_item' THEN 'toc'
                 WHEN lower(norm) = 'bibliography' OR contains(ls, 'bibliography') OR ot = 'bibliography_item' THEN 'bibliography' WHEN ot = 'heading' THEN 'main_body' END AS anchor FROM b3""",
        "b5": """SELECT *, CASE WHEN tab OR emp THEN 4 WHEN always THEN 0 WHEN anchor IS NOT NULL AND it = 'appendix_heading' THEN 1 WHEN anchor IS NOT NULL THEN 0
                WHEN dz = 'unknown_zone' THEN 4 WHEN ot = 'title_meta' OR (dz = 'main_body' AND style = '') THEN 3 ELSE 2 END AS power, CASE WHEN always THEN 'appendix' ELSE coalesce(anchor, dz) END AS tz FROM b4""",
        "b5t": "SELECT *, (contains(ls, 'title')) AND NOT tab AND NOT emp AND NOT always AND coalesce(anchor = 'main_body', true) AS titled FROM b5",
        **zones_sql(),
        "b12": """SELECT *, CASE WHEN tab THEN 'table' WHEN emp THEN 'empty' WHEN zb = 'appendix' THEN it ELSE ot END AS bt,
            CASE WHEN tab THEN zb WHEN emp THEN CASE WHEN zb IN ('title_page', 'control_sheet', 'toc') THEN zb ELSE 'unknown_zone' END ELSE za END AS zone FROM b11""",
        "b13": rf"""SELECT *, bt IN ('heading', 'appendix_heading') AS hd, NOT tab AND NOT emp AND rt IS NULL AS guessed,
            CASE WHEN bt = 'appendix_heading' THEN coalesce(upper(nullif(regexp_extract(norm, '(?i)^\s*Appendix\s+({LETTER})(?:{NON}|$)', 1), '')), {letter}, {own_number}) WHEN bt = 'heading' THEN {own_number} END AS number,
            CASE WHEN bt = 'appendix_heading' AND regexp_matches(norm, '{root_title}') THEN coalesce(nullif({strip(f"regexp_extract(norm, '{root_title}', 1)", r" .:\-")}, ''), norm)
                 WHEN bt = 'appendix_heading' THEN coalesce(nullif(regexp_extract(norm, '^\s*{LETTER}(?:\.[0-9]+){{0,5}}\s+(.+)$', 1), ''), {after_number})
                 WHEN bt = 'heading' THEN {after_number} END AS title,
            try_cast(regexp_extract(style, '(?i)(?:^|\s)heading\s*([0-9]+)(?:{NON}|$)', 1) AS INTEGER) AS stylelevel FROM b12""",
        "b14": """SELECT *, CASE WHEN NOT tab AND NOT emp AND rt IS NOT NULL THEN rs WHEN guessed AND bt = 'appendix_heading' THEN 'appendix_heading_fallback'
                WHEN guessed AND hd AND hs THEN 'style_heading_fallback' WHEN guessed AND hd THEN 'numbered_heading_fallback' WHEN guessed THEN 'plain_paragraph_fallback' END AS subtype,
            CASE WHEN hd AND rt IS NOT NULL THEN 'style_registry' WHEN hd AND hs THEN 'style_fallback' WHEN hd THEN 'text_fallback' END AS method,
            CASE WHEN bt = 'appendix_heading' THEN coalesce(len(string_split(number, '.')), CASE WHEN rl IS NOT NULL THEN greatest(rl, 2) END, CASE WHEN stylelevel IS NOT NULL THEN greatest(stylelevel, 2) END, 2)
                 WHEN bt = 'heading' THEN coalesce(rl, stylelevel, len(string_split(number, '.')), 1) END AS hl,
            CASE WHEN emp THEN 'is_empty' WHEN guessed THEN 'needs_review,is_suspicious' ELSE coalesce(rflags, '') END AS flags FROM b13""",
        "b15": rf"""SELECT *, CASE WHEN coalesce(hl, 0) = 0 THEN 1 ELSE hl END AS lvl, coalesce(title, norm) AS ttl, bt = 'heading' AND zone = 'main_body' AS om, bt = 'appendix_heading' AND zone = 'appendix' AS oa,
            coalesce(number, 'UNNUMBERED_' || block_order) AS idm,
            coalesce(nullif(regexp_extract(norm, '^\s*Appendix\s+({LETTER})(?:{NON}|$)', 1), ''), {letter}, number, 'APP_UNNUMBERED_' || block_order) AS ida FROM b14""",
        "b16": f"SELECT *, {tops('m', 'om', 'idm')}, {tops('a', 'oa', 'ida')} FROM b15 {W}",
        "b17": f"SELECT * EXCLUDE ({', '.join(f'm{k}, a{k}' for k in range(1, 10))}), CASE WHEN zone = 'main_body' THEN {stack('m')} WHEN zone = 'appendix' THEN {stack('a')} ELSE [] END AS st FROM b16",
        "b18": "SELECT *, list_transform(st, lambda x: x.id) AS path, st[-1].id AS sid, st[-1].title AS stitle, st[-1].lvl AS slevel, st[-2].id AS parent FROM b17",
        "n0": """SELECT *, CASE WHEN tab THEN NULL WHEN style = 'Note label' THEN 'note_label' WHEN style = 'Note text' THEN 'note_text' WHEN subtype IN ('note_label', 'note_text') THEN subtype END AS note FROM b18""",
        "n1": f"SELECT *, coalesce(note = 'note_label' AND lead(note) OVER w = 'note_text' AND lead(zone) OVER w = zone, false) AS st1 FROM n0 {W}",
        "n2": f"SELECT *, coalesce(lag(st1) OVER w, false) AS en1, sum(CASE WHEN st1 THEN 1 ELSE 0 END) OVER f AS gno FROM n1 {W}",
        "n3": f"""SELECT * REPLACE (coalesce(note, bt) AS bt), CASE WHEN st1 OR en1 THEN printf('note_group_%04d', CAST(gno AS BIGINT)) END AS grp, CASE WHEN note IS NOT NULL THEN NOT (st1 OR en1) END AS orphan,
            CASE note WHEN 'note_label' THEN 'label' WHEN 'note_text' THEN 'text' END AS role, printf('b%06d', block_order) AS bid FROM n2""",
        "r0": rf"""SELECT *, bt = 'empty' OR contains(flags, 'is_empty') OR (norm = '' AND NOT tab) AS artifact,
            CASE WHEN method = 'style_registry' THEN 'registry' WHEN contains(method, 'fallback') THEN 'fallback' WHEN method IS NOT NULL THEN 'heuristic' END AS source,
            regexp_matches(norm, '(?i)^\s*table(?:{NON}|$)') AS ltab, regexp_matches(norm, '(?i)^\s*figure(?:{NON}|$)') AS lfig, regexp_matches(norm, '(?i)^\s*note(?:{NON}|$)') AS lnote,
            regexp_matches(norm, '^\s*(?:appendix\s+{LETTER}|{LETTER}(?:\.[0-9]+){{1,5}})(?:{NON}|$)') AS lapp, ends_with(norm, ':') AS colon FROM n3""",
        "r1": """SELECT *, lag(bid) OVER w AS pid, lead(bid) OVER w AS nid, lag(bt) OVER w AS pt, lead(bt) OVER w AS nt,
            coalesce(first_value(CASE WHEN NOT artifact THEN bt END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY block_order ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) = 'list_item', false) AS lf
            FROM r0 WINDOW w AS (PARTITION BY document_id ORDER BY block_order)""",
        "r2": """SELECT *, list_filter([CASE WHEN hd2 AND (contains(flags, 'needs_review') OR contains(flags, 'is_suspicious')) THEN 'suspicious_heading' END, CASE WHEN hd2 AND source = 'fallback' THEN 'fallback_heading' END,
                CASE WHEN hd2 AND colon AND lf THEN 'heading_with_colon_before_list' END, CASE WHEN bt = 'figure' AND ltab THEN 'figure_text_looks_like_table' END,
                CASE WHEN bt IN ('note_label', 'note_text', 'note_like') AND orphan THEN 'orphan_note' END, CASE WHEN bt = 'note_like' AND NOT coalesce(orphan, false) AND lnote THEN 'note_anchor_ambiguity' END,
                CASE WHEN lapp AND bt <> 'appendix_heading' THEN 'appendix_like_non_appendix_block' END,
                CASE WHEN artifact AND pid IS NOT NULL AND nid IS NOT NULL AND (pt, nt) IN (('table_caption', 'table'), ('note_label', 'note_text'), ('figure_caption', 'figure')) THEN 'layout_artifact_between_related_blocks' END
            ], lambda x: x IS NOT NULL) AS reasons FROM (SELECT *, bt IN ('heading', 'appendix_heading') AS hd2 FROM r1)""",
    }


MARKS = [("with", "obligation"), ("that", "obligation"), ("from", "necessity"), ("by", "recommendation")]
ANY = "with|that|from|by"


def cut_at(words: str) -> str:
    return rf"(?is)^((?:.*?{NON})??)({words})((?:{NON}.*)?)$"


def whole(words: str) -> str:
    return rf"(?i)(?:^|{NON})(?:{words})(?:{NON}|$)"


def requirement_sql() -> dict[str, str]:
    kind = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(norm, '{whole(w)}') THEN '{k}' END" for w, k in MARKS) + ")"
    req = strip(
        r"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(candidate_text, ''), '[\s ]+', ' ', 'g')), '^(?:[-•–]|[0-9]+[.)]|[A-Za-zА-Яа-я]\))\s+', ''), '\s+([:;,.])', '\1', 'g'), '[:;]$', '')"
    )
    cond, mark = cut_at("when|if"), cut_at(ANY)
    return {
        **analysis_sql(lines_sql(), LINE_STYLES),
        "q0": f"SELECT *, bt <> 'heading' AS src, CASE WHEN bt <> 'heading' THEN {kind} END AS own FROM r2 WHERE zone = 'main_body' AND bt IN ('paragraph', 'list_item', 'note_text', 'note_like', 'heading') AND (bt = 'heading' OR norm <> '')",
        "q1": f"""SELECT *, CASE WHEN NOT src THEN false WHEN own IS NOT NULL THEN true WHEN bt <> 'list_item' THEN false
            WHEN lag(path) OVER w IS NULL OR lag(path) OVER w <> path THEN false END AS known FROM q0 {W}""",
        "q2": f"SELECT *, last_value(known IGNORE NULLS) OVER f AS taken FROM q1 {W}",
        "cand": """SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY block_order) AS n, bid, block_order, path, zone, norm AS candidate_text,
            CASE WHEN own IS NOT NULL THEN 'normative_marker_' || bt ELSE 'normative_context_list_item' END AS reason, CASE WHEN own IS NULL THEN 0.78 WHEN bt = 'list_item' THEN 0.92 ELSE 0.95 END AS confidence,
            coalesce(own, 'contextual_obligation') AS rkind FROM q2 WHERE src AND (own IS NOT NULL OR (bt = 'list_item' AND taken))""",
        "c1": f"SELECT *, {req} AS rnorm, lead(reason) OVER x AS nreason, lead(path) OVER x AS npath FROM cand WINDOW x AS (PARTITION BY document_id ORDER BY n)",
        "c2": rf"""SELECT *, list_filter(list_transform(string_split(regexp_replace(rnorm, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '' AND regexp_matches(x, '{whole(ANY)}')) AS sents,
            list_filter(list_transform(string_split(rnorm, ';'), lambda x: {strip('x')}), lambda x: x <> '') AS clauses FROM c1""",
        "rec": r"""SELECT *, CASE WHEN reason = 'normative_context_list_item' THEN 'contextual_list_item'
            WHEN starts_with(reason, 'normative_marker_') AND regexp_matches(candidate_text, ':\s*$') AND rnorm <> '' AND nreason = 'normative_context_list_item' AND npath = path THEN 'list_header_context'
            WHEN len(sents) > 1 THEN 'sentence_split' WHEN len(clauses) > 1 THEN 'semicolon_split' ELSE 'single_atomic' END AS strategy FROM c2""",
        "parts": """SELECT * EXCLUDE (ps), unnest(ps) AS atext, generate_subscripts(ps, 1) AS ano FROM (SELECT *, CASE strategy WHEN 'list_header_context' THEN [] WHEN 'sentence_split' THEN sents WHEN 'semicolon_split' THEN clauses ELSE [rnorm] END AS ps FROM rec)""",
        "h0": rf"""SELECT *, regexp_matches(atext, '{cond}') AS cutc FROM parts""",
        "h1": rf"""SELECT *, CASE WHEN cutc THEN regexp_extract(atext, '{cond}', 2) || regexp_extract(atext, '{cond}', 3) END AS condition,
            CASE WHEN cutc THEN regexp_replace({strip(f"regexp_extract(atext, '{cond}', 1)")}, ',+$', '') ELSE atext END AS hd1 FROM h0""",
        "h2": rf"""SELECT *, regexp_matches(hd1, '{mark}') AS has, nullif({strip(f"regexp_extract(hd1, '{mark}', 1)", " ,")}, '') AS sub0, {strip(f"regexp_extract(hd1, '{mark}', 3)", " ,")} AS tail FROM h1""",
        "h3": r"""SELECT *, CASE WHEN has THEN sub0 END AS subject, CASE WHEN has THEN nullif(regexp_extract(tail, '^(\S+)', 1), '') END AS act0,
            CASE WHEN has THEN nullif(regexp_extract(tail, '(?s)^\S+\s+(.*)$', 1), '') ELSE nullif(hd1, '') END AS obj0 FROM h2""",
        "atoms": r"""SELECT document_id, n, printf('reqr_%04d', n) AS requirement_id, strategy, rkind, zone, path, printf('reqa_%04d_%02d', n, ano) AS atomic_id, ano, atext, subject,
            CASE WHEN rkind = 'contextual_obligation' AND act0 IS NULL THEN nullif(regexp_extract(atext, '^(\S+)', 1), '') ELSE act0 END AS action,
            CASE WHEN rkind = 'contextual_obligation' AND act0 IS NULL THEN nullif(regexp_extract(atext, '(?s)^\S+\s+(.*)$', 1), '') ELSE obj0 END AS object, condition,
            CASE strategy WHEN 'sentence_split' THEN 'sentence' WHEN 'semicolon_split' THEN 'clause' WHEN 'contextual_list_item' THEN 'list_item' ELSE 'full_text' END AS span,
            CASE strategy WHEN 'sentence_split' THEN 0.82 WHEN 'semicolon_split' THEN 0.8 WHEN 'contextual_list_item' THEN 0.84 ELSE 0.9 END AS confidence FROM h3""",
        "agg": "SELECT document_id, n, count(*) AS na, bool_or(subject IS NULL) AS nosub, bool_or(condition IS NOT NULL) AS hascond, arg_min(subject, ano) AS sub1, string_agg(atomic_id, ',' ORDER BY ano) AS aids FROM atoms GROUP BY document_id, n",
        "v0": """SELECT rec.*, coalesce(na, 0) AS na, nosub, hascond, sub1, coalesce(aids, '') AS aids, lead(strategy) OVER x AS nstrat, lead(path) OVER x AS np2, coalesce(lag(path) OVER x = path, false) AS lastsame
            FROM rec LEFT JOIN agg USING (document_id, n) WINDOW x AS (PARTITION BY document_id ORDER BY n)""",
        "v1": """SELECT *, CASE WHEN strategy = 'list_header_context' AND coalesce(nstrat = 'contextual_list_item' AND np2 = path, false) THEN 'requires_list_item_context' WHEN strategy = 'list_header_context' THEN 'dangling_list_header'
            WHEN strategy = 'contextual_list_item' AND na > 0 AND sub1 IS NULL THEN 'missing_subject_context' WHEN strategy = 'sentence_split' AND nosub THEN 'mixed_subject_scope'
            WHEN strategy = 'semicolon_split' AND hascond THEN 'conditional_clause_scope' END AS ambiguity,
            sum(CASE WHEN strategy = 'contextual_list_item' AND lastsame THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY n) AS run FROM v0""",
        "v2": """SELECT *, string_agg(printf('reqr_%04d', n), ',') OVER (PARTITION BY document_id, run ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ids, lag(n) OVER (PARTITION BY document_id ORDER BY n) AS ln FROM v1""",
        "cases": """SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n) AS cno,
            CASE WHEN ambiguity = 'requires_list_item_context' THEN coalesce(ids, '') WHEN lastsame THEN printf('reqr_%04d', ln) ELSE '' END AS context FROM v2 WHERE ambiguity IS NOT NULL""",
        "dec": """SELECT *, CASE ambiguity WHEN 'requires_list_item_context' THEN 'safe_auto_apply' WHEN 'missing_subject_context' THEN 'safe_auto_apply' WHEN 'conditional_clause_scope' THEN 'review_recommended' ELSE 'needs_human_review' END AS label,
            CASE ambiguity WHEN 'requires_list_item_context' THEN 'mark_context_only' WHEN 'dangling_list_header' THEN 'confirm_missing_list_items' WHEN 'missing_subject_context' THEN 'apply_subject_from_parent_context'
                WHEN 'mixed_subject_scope' THEN 'verify_split_sentence_scope' ELSE 'check_condition_attachment' END AS act,
            CASE ambiguity WHEN 'requires_list_item_context' THEN 0.93 WHEN 'dangling_list_header' THEN 0.91 WHEN 'missing_subject_context' THEN 0.89 WHEN 'mixed_subject_scope' THEN 0.84 ELSE 0.8 END AS dconf FROM cases""",
        "p0": "SELECT document_id, n, path, strategy, rnorm, " + "CASE " + " ".join(f"WHEN position(' {w} ' IN lower(rnorm)) > 0 THEN nullif({strip(f'''substr(rnorm, 1, position(' {w} ' IN lower(rnorm)) - 1)''', ' ,')}, '')" for w, _ in MARKS) + " END AS ps FROM rec",
        "p1": "SELECT document_id, n, last_value(CASE WHEN strategy = 'list_header_context' THEN ps END IGNORE NULLS) OVER (PARTITION BY document_id, path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS psub FROM p0",
        "lg": """SELECT dec.*, psub, CASE WHEN act IN ('mark_context_only', 'apply_subject_from_parent_context') THEN 'auto_applicable' ELSE 'requires_human_review' END AS policy,
            act = 'mark_context_only' OR (act = 'apply_subject_from_parent_context' AND psub IS NOT NULL) AS done FROM dec JOIN p1 USING (document_id, n)""",
        "lo": """SELECT *, CASE WHEN done THEN act ELSE 'attach_review_flag' END AS op, CASE WHEN done THEN '' WHEN policy = 'auto_applicable' THEN act || '_unresolved' ELSE act END AS flag FROM lg""",
        "ap": """SELECT rec.document_id, rec.n, rec.bid, rec.zone, rec.path, rec.rnorm, rec.rkind, rec.strategy, coalesce(lo.op, 'keep_as_is') AS op, coalesce(lo.flag, '') AS flag, lo.psub, lo.act, lo.policy
            FROM rec LEFT JOIN lo USING (document_id, n)""",
        "aa": """SELECT ap.document_id, ap.n, ap.bid, ap.zone, ap.path, ap.rkind, ap.op, ap.flag, a.ano, a.atomic_id, a.atext, CASE WHEN ap.op = 'apply_subject_from_parent_context' THEN ap.psub ELSE a.subject END AS subject, a.action, a.object
            FROM ap LEFT JOIN atoms a ON a.document_id = ap.document_id AND a.n = ap.n WHERE a.n IS NOT NULL OR ap.op = 'mark_context_only'""",
        "g0": f"""SELECT *, {strip('atext')} AS tx, {trim_sql('atext')} AS short, {trim_sql('subject')} AS qs, {trim_sql('action')} AS qa, {trim_sql('object')} AS qo FROM aa""",
        "g1": """SELECT *, contains(lower(tx), 'tion') OR contains(lower(tx), 'ord') AS ev, contains(lower(tx), 'ing') OR contains(lower(tx), 'ent') AS pr, rkind IN ('obligation', 'contextual_obligation') AS nk FROM g0""",
        "g2": r"""SELECT *, CASE WHEN ano IS NULL OR zone <> 'main_body' OR op = 'mark_context_only' THEN 'context_only' WHEN flag <> '' THEN 'unresolved' WHEN len(string_split_regex(tx, '\s+')) < 2 THEN 'non_actionable'
                WHEN nullif(action, '') IS NULL AND NOT (nk AND (ev OR pr)) THEN 'non_actionable' WHEN short IS NULL THEN 'non_actionable' END AS skip,
            CASE WHEN ev THEN 'evidence_check' WHEN pr OR NOT nk THEN 'process_check' ELSE 'implementation_check' END AS qt,
            CASE WHEN ev THEN 'How is it confirmed: ' || lower(short) || '?' WHEN (pr OR NOT nk) AND qa IS NOT NULL AND qo IS NOT NULL THEN 'In what way is it done: ' || qa || ' ' || lower(qo) || '?'
                WHEN pr OR NOT nk THEN 'How is it ensured: ' || lower(short) || '?' WHEN qs IS NOT NULL AND qa IS NOT NULL THEN 'In what way ' || concat_ws(' ', lower(qs), lower(qa), lower(qo)) || '?'
                WHEN qa IS NOT NULL AND qo IS NOT NULL THEN 'In what way is it done: ' || lower(qa) || ' ' || lower(qo) || '?' ELSE 'How is it done: ' || lower(short) || '?' END AS qtext FROM g1""",
        "qu": "SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n, ano) AS qno FROM g2 WHERE skip IS NULL",
    }


def trim_sql(x: str) -> str:
    return f"nullif({strip(f'''regexp_replace({strip(x)}, '[.;: ]+$', '')''')}, '')"


def composed(steps: dict[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in steps.items()) + "\n" + final


def lines(final: str) -> str:
    return composed(analysis_sql(lines_sql(), LINE_STYLES), final)


def deep(final: str) -> str:
    return composed(analysis_sql(deep_sql(), DEEP_STYLES), final)


def pages(final: str) -> str:
    return composed(analysis_sql(pages_sql(), TAG_STYLES), final)


def requirements(final: str) -> str:
    return composed(requirement_sql(), final)
