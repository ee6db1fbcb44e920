"""Checking SQL for company names: the same rule ladders as staged sub-queries."""

from jobflow import rules
from jobflow.functions.names import row_patterns
from jobflow.plans import sql as S

EDGE, EDGE_BRACKETS = " -:|,.;", " -:|,.;()[]{}"


def lookup(table, key):
    return f"list_extract({S.items(table.values())}, list_position({S.items(table.keys())}, {key}))"


def alternation(words):
    return "|".join(w.replace(".", r"\.").replace("|", r"\|") for w in words)


def canonical(source, x="raw", out="name"):
    """``source`` rows plus ``out``: the display name of ``x`` or NULL."""
    cut = f"regexp_replace(v0, {S.q(chr(92) + 's+' + chr(92) + '|' + chr(92) + 's+.*$')}, '')"
    cut = f"regexp_replace({cut}, {S.q(rf'\s+({alternation(rules.TEAM_SUFFIXES)})$')}, '', 'i')"
    cut = f"regexp_replace({cut}, {S.q(rf'\s+({alternation(rules.DEPARTMENT_SUFFIXES)})$')}, '', 'i')"
    cut = f"regexp_replace({cut}, {S.q(r'\s+\(.*?\)$')}, '')"
    alias = rules.COMPANY_ALIASES
    noise = rf"\b({alternation(rules.NAME_NOISE_WORDS)})\b"
    return f"""
SELECT * EXCLUDE (v0, v1, low, tok, titled), CASE
  WHEN v0 IS NULL OR v0 = '' OR contains(v0, '@') THEN NULL
  WHEN {lookup(alias, 'lower(v0)')} IS NOT NULL THEN {lookup(alias, 'lower(v0)')}
  WHEN v1 = '' THEN NULL
  WHEN {lookup(alias, 'low')} IS NOT NULL THEN {lookup(alias, 'low')}
  WHEN {S.in_list('low', rules.GENERIC_COMPANIES)} OR {S.in_list('low', rules.STUB_NAMES)} OR regexp_matches(low, {S.q(noise)}) THEN NULL
  WHEN suffix(low, ' university') OR contains(low, 'national laboratory') THEN titled
  WHEN NOT contains(v1, ' ') THEN CASE WHEN tok = '' OR {S.in_list('lower(tok)', rules.GENERIC_PREFIXES)} THEN NULL
    WHEN {lookup(alias, 'lower(tok)')} IS NOT NULL THEN {lookup(alias, 'lower(tok)')}
    WHEN (upper(tok) = tok AND regexp_matches(tok, '[A-Za-z]')) OR regexp_matches(tok, '[0-9]') THEN tok
    ELSE upper(tok[1:1]) || tok[2:] END
  WHEN {S.in_list('lower(titled)', rules.GENERIC_COMPANIES)} THEN NULL
  ELSE titled END AS {out}
FROM (SELECT *, lower(v1) AS low, regexp_replace(v1, '[^A-Za-z0-9&+-]', '', 'g') AS tok, {S.title_words('v1')} AS titled
  FROM (SELECT *, trim({S.squash(cut)}, {S.q(EDGE)}) AS v1
    FROM (SELECT *, trim({S.squash(x)}, {S.q(EDGE_BRACKETS)}) AS v0 FROM ({source}))))"""


def sender(source):
    """(seq, name) of the sender part; ``source`` has seq and row."""
    addr = f"regexp_extract(line, {S.q('(' + S.EMAIL + ')')}, 1)"
    local, domain = "lower(split_part(addr, '@', 1))", "lower(split_part(addr, '@', 2))"
    pieces = f"regexp_split_to_array({local}, '[._+-]+')"
    piece_alias = (
        f"list_filter(list_transform({pieces}, lambda p: {lookup(rules.COMPANY_ALIASES, 'p')}), lambda a: a IS NOT NULL)[1]"
    )
    from_addr = (
        f"CASE WHEN addr <> '' THEN coalesce({lookup(rules.EMAIL_DOMAIN_COMPANIES, domain)}, "
        f"{lookup(rules.COMPANY_ALIASES, local)}, {piece_alias}) END"
    )
    pre = f"regexp_replace(line, {S.q(rf'\s+(?:{alternation(rules.SUBJECT_STARTS)}).*$')}, '', 'is')"
    for mark in rules.SENDER_CUTS:
        pre = f"split_part({pre}, {S.q(mark)}, 1)"
    short = S.squash(f"regexp_replace(pre, {S.q(rf'\s+({alternation(rules.SENDER_SUFFIXES)})$')}, '', 'i')")
    base = f"""SELECT seq, line, {from_addr} AS from_addr, pre FROM (
      SELECT seq, line, {addr} AS addr, trim({S.squash(pre)}, {S.q(EDGE)}) AS pre FROM (
        SELECT seq, {S.squash('row')} AS line FROM ({source})))"""
    usable = "(pre <> '' AND NOT (contains(pre, '@') AND NOT contains(pre, ' ')))"
    raw = f"""
      SELECT seq, 1 AS slot, string_split(pre, ' - ')[-1] AS raw FROM b WHERE {usable} AND contains(pre, ' - ')
      UNION ALL SELECT seq, 2, split_part(pre, ':', 1) FROM b WHERE {usable} AND contains(pre, ':')
      UNION ALL SELECT seq, 3, short FROM (SELECT seq, pre, {short} AS short FROM b) WHERE {usable}
        AND short <> '' AND len(string_split(short, ' ')) <= 6"""
    return f"""
    WITH b AS MATERIALIZED ({base}), n AS ({canonical(raw)})
    SELECT b.seq, coalesce(from_addr, s.name) AS name FROM b
    LEFT JOIN (SELECT seq, arg_min(name, slot) AS name FROM n WHERE name IS NOT NULL GROUP BY seq) s USING (seq)"""


def candidates(source):
    """(seq, name), one row per hit, repeats kept; ``source`` has seq and row."""
    captures = " UNION ALL ".join(
        f"SELECT seq, unnest(regexp_extract_all(line, {S.q(p)}, 1, 'i')) AS raw FROM lines" for p in row_patterns()
    )
    return f"""
    SELECT seq, name FROM ({sender(source)}) WHERE name IS NOT NULL
    UNION ALL SELECT seq, name FROM ({canonical(f"WITH lines AS MATERIALIZED (SELECT seq, {S.squash('row')} AS line FROM ({source})) {captures}")})
    WHERE name IS NOT NULL"""


def tails(v):
    """Texts behind each "at" of ``v`` that run to the end in name characters."""
    words = f"string_split({v}, ' ')"
    at = r"(?i)(^|[^\p{L}\p{N}_])at$"
    found = f"list_transform({words}, lambda t, i: CASE WHEN regexp_matches(t, {S.q(at)}) THEN array_to_string({words}[i + 1:], ' ') END)"
    ok = f"list_filter({found}, lambda x: x IS NOT NULL AND regexp_full_match(x, {S.q(rules.NAME_CHARS + '+')}))"
    return f"list_transform({ok}, lambda x: trim({S.squash('x')}, {S.q(EDGE)}))"


def candidate(source, x="raw"):
    """(x, name) per distinct ``x`` of ``source``: the company behind a raw name, or NULL."""
    role = rf"(?i)\b({alternation(rules.SPLIT_ROLE_WORDS)})\b"
    cut = "t"
    for p in [*rules.LEADING_STRIPS, *rules.TRAILING_CUTS]:
        cut = f"regexp_replace({cut}, {S.q(p)}, '', 'i')"
    fix = rules.NAME_FIXES
    noise = "|".join(rules.NOISE_NAME_PATTERNS)
    low = "lower(v)"
    valid = (
        f"(v <> '' AND NOT regexp_matches(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND NOT regexp_matches({low}, {S.q(noise)}) "
        f"AND NOT {S.in_list(low, rules.BARE_ROLES)} AND NOT (regexp_matches({low}, '^(our|the) ') AND NOT contains({low}, ' at ') "
        f"AND NOT contains({low}, 'laboratory')) AND len(regexp_split_to_array(v, ' +')) <= 8)"
    )
    key = S.norm_key("v")
    generic = f"({key} <> '' AND len(list_filter(string_split({key}, ' '), lambda t: NOT {S.in_list('t', rules.GENERIC_ROLE_WORDS)})) = 0)"
    nodes = f"""
      SELECT {x}, list_concat([v], {tails('v')}) AS texts FROM (
        SELECT DISTINCT {x}, trim({S.squash(x)}, {S.q(EDGE)}) AS v FROM ({source}))"""
    spread = f"SELECT {x}, unnest(texts) AS t, generate_subscripts(texts, 1) AS j FROM ({nodes})"
    lefts = f"""
      SELECT {x}, j, list_concat([v], {tails('v')}) AS texts FROM (
        SELECT {x}, j, trim({S.squash("split_part(t, ' - ', 1)")}, {S.q(EDGE)}) AS v FROM ({spread})
        WHERE contains(t, ' - ') AND regexp_matches(substr(t, strpos(t, ' - ') + 3), {S.q(role)}))"""
    ordered = f"""
      SELECT {x}, t, 1000000 - j AS ord FROM ({spread})
      UNION ALL SELECT {x}, t, j * 1000 - k AS ord FROM (
        SELECT {x}, j, unnest(texts) AS t, generate_subscripts(texts, 1) AS k FROM ({lefts}))"""
    named = canonical(
        f"SELECT *, trim({S.squash(cut)}, {S.q(EDGE)}) AS cleaned FROM ({ordered})", "cleaned", "canon"
    )
    fixed = f"CASE WHEN {lookup(fix, 'lower(t)')} IS NOT NULL THEN nullif({lookup(fix, 'lower(t)')}, '')"
    return f"""
    SELECT {x}, arg_min(own, ord) FILTER (WHERE own IS NOT NULL) AS name FROM (
      SELECT {x}, ord, CASE WHEN t = '' THEN NULL ELSE {fixed} WHEN cleaned = '' THEN NULL
        WHEN {lookup(fix, 'lower(cleaned)')} IS NOT NULL THEN nullif({lookup(fix, 'lower(cleaned)')}, '')
        WHEN {valid} AND NOT {generic} THEN v END END AS own
      FROM (SELECT *, coalesce(canon, cleaned) AS v FROM ({named}))) GROUP BY {x}"""


def ats_hints(x):
    """List of (kind, value) hint names in a lower-case text."""
    fragments = {}
    for fragment, name in [*rules.ATS_DOMAIN_HINTS.items(), *rules.ATS_KEYWORD_HINTS.items()]:
        fragments.setdefault(name, []).append(fragment)
    arms = ", ".join(f"CASE WHEN {S.contains_any(x, p)} THEN {S.q(n)} END" for n, p in sorted(fragments.items()))
    return f"list_filter([{arms}], lambda h: h IS NOT NULL)"


_DOMAIN = r"\b([a-z0-9.-]+\.[a-z]{2,})(?:/[^\s]*)?\b"


def evidence_ctes(mail, limited=False):
    """CTE list: mail, cand(seq, company), ev_count, ev_vals(company, kind, value), ev_example."""
    email = f"lower(regexp_extract(row, {S.q('(' + S.EMAIL + ')')}, 1))"
    sdom = "split_part(email, '@', 2)"
    domains = (
        f"list_filter(list_transform(regexp_extract_all(lower(row), {S.q(_DOMAIN)}, 1), lambda d: trim(d, '.')), lambda d: NOT "
        f"{S.contains_any('d', rules.VENDOR_DOMAINS)} AND NOT {S.ends_any('d', rules.IMAGE_SUFFIXES)})"
    )
    return f"""
  mail AS MATERIALIZED ({mail}),
  cand AS MATERIALIZED (SELECT DISTINCT seq, name AS company FROM ({candidates('SELECT * FROM mail')})
    WHERE NOT {S.in_list('name', rules.GENERIC_COMPANIES)}),
  fact AS MATERIALIZED (SELECT seq, row, email FROM (SELECT seq, row, {email} AS email FROM mail)),
  ev_count AS MATERIALIZED (SELECT company, count(*) AS count FROM cand GROUP BY company),
  ev_vals AS MATERIALIZED (SELECT DISTINCT company, kind, value FROM cand JOIN (
      SELECT seq, 'hint' AS kind, unnest({ats_hints('lower(row)')}) AS value FROM fact
      UNION ALL SELECT seq, 'domain', unnest({domains}) FROM fact
      UNION ALL SELECT seq, 'domain', {sdom} FROM fact WHERE email <> '' AND NOT {S.contains_any(sdom, rules.VENDOR_DOMAINS)}
      UNION ALL SELECT seq, 'sender', {sdom} FROM fact WHERE email <> ''
      UNION ALL SELECT seq, 'email', email FROM fact WHERE email <> '') USING (seq)),
  ev_example AS MATERIALIZED (SELECT company, rank, {'substr(row, 1, 400)' if limited else 'row'} AS example FROM (
      SELECT company, seq, row_number() OVER (PARTITION BY company ORDER BY seq) AS rank FROM cand) JOIN mail USING (seq)
      {'WHERE rank <= 3' if limited else ''})"""


def joined(rel, key, kind, order="value"):
    return (
        f"coalesce((SELECT string_agg(value, ';' ORDER BY {order}) FROM {rel} x "
        f"WHERE x.{key} = b.{key} AND x.kind = '{kind}'), '')"
    )


def registry_ctes(mail, limited=False):
    """evidence_ctes plus votes, resolved, and the merged registry m_count, m_vals, m_example."""
    root = S.root_domain
    vendor = lambda x: S.contains_any(x, rules.VENDOR_DOMAINS)
    personal = lambda x: S.in_list(x, rules.PERSONAL_DOMAINS)
    host = "split_part(value, '@', 2)"
    local = (
        f"list_filter(regexp_split_to_array(lower(split_part(value, '@', 1)), '[._+-]+'), lambda t: t <> '' AND NOT "
        f"{S.in_list('t', rules.SENDER_STOP_TOKENS)} AND NOT regexp_matches(t, '^[a-z][0-9]+$'))"
    )
    overrides = " UNION ALL ".join(
        f"SELECT resolved, 'domain', {S.q(d)} FROM m_count WHERE resolved = {S.q(c)}"
        for c, ds in rules.COMPANY_DOMAIN_OVERRIDES.items() for d in ds
    )
    return f"""{evidence_ctes(mail, limited)},
  ex_rows AS MATERIALIZED (SELECT row_number() OVER () AS seq, company, example AS row FROM ev_example),
  ballot AS MATERIALIZED (
    SELECT company, company AS raw, 2 AS weight FROM ev_count
    UNION ALL SELECT company, name, 5 FROM ex_rows JOIN ({candidates('SELECT seq, row FROM ex_rows')}) USING (seq)
    UNION ALL SELECT company, unnest(CASE WHEN {personal('r')} THEN [] WHEN {vendor('r')} THEN {local} ELSE [split_part(r, '.', 1)] END), 3
      FROM (SELECT *, {root(host)} AS r FROM ev_vals WHERE kind = 'email')
    UNION ALL SELECT company, split_part(r, '.', 1), 3 FROM (SELECT *, {root('value')} AS r FROM ev_vals WHERE kind = 'domain')
      WHERE NOT {personal('r')} AND NOT {vendor('r')}),
  known AS MATERIALIZED ({candidate('SELECT raw FROM ballot')}),
  votes AS MATERIALIZED (SELECT company, name AS candidate, CAST(sum(weight) AS BIGINT) AS votes
    FROM ballot JOIN known USING (raw) WHERE name IS NOT NULL GROUP BY company, name),
  resolved AS MATERIALIZED (SELECT company, candidate AS resolved FROM (SELECT *, row_number() OVER (PARTITION BY company
      ORDER BY votes DESC, length(candidate), lower(candidate), candidate) AS rn FROM votes) WHERE rn = 1),
  m_count AS MATERIALIZED (SELECT resolved, CAST(sum(count) AS BIGINT) AS count FROM ev_count JOIN resolved USING (company) GROUP BY resolved),
  m_vals AS MATERIALIZED (SELECT DISTINCT resolved, kind, value FROM (
      SELECT resolved, 'alias' AS kind, company AS value FROM resolved
      UNION ALL SELECT resolved, kind, value FROM resolved JOIN ev_vals USING (company) WHERE kind IN ('hint', 'email')
      UNION ALL SELECT resolved, 'sender', {root('value')} FROM resolved JOIN ev_vals USING (company) WHERE kind = 'sender'
      UNION ALL SELECT resolved, 'domain', r FROM (SELECT resolved, kind, {root("CASE kind WHEN 'email' THEN split_part(value, '@', 2) ELSE value END")} AS r
        FROM resolved JOIN ev_vals USING (company) WHERE kind IN ('domain', 'email'))
        WHERE NOT {personal('r')} AND NOT {vendor('r')} AND (kind = 'email' OR NOT {S.ends_any('r', rules.DOMAIN_ASSET_SUFFIXES)})
      UNION ALL {overrides})),
  m_example AS MATERIALIZED (SELECT resolved, rank, example FROM (
      SELECT resolved, example, row_number() OVER (PARTITION BY resolved ORDER BY pos) AS rank FROM (
        SELECT resolved, example, min((lower(company), company, rank)) AS pos FROM resolved JOIN ev_example USING (company)
        GROUP BY resolved, example)) {'WHERE rank <= 5' if limited else ''})"""
