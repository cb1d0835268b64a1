"""SQL counterparts of this package's queries, for a database that has the same tables as views."""

from __future__ import annotations

from quillon.llm import decontaminate, langid, licences, substrings, warc

_WORDS = "list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_SPACED = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: tb: the table of CRC-32; _crc: the checksum of a list of bytes.
_CRC_TABLE = "tb as (select list(v order by n) as t from (select n, list_reduce(list_prepend(n, range(0, 8)), lambda v, k: case when v & 1 = 1 then xor(3988292384, v >> 1) else v >> 1 end) as v from range(256) r(n)))"


def _crc(bytes_: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(list_extract(t, cast((xor(c, b) & 255) + 1 as int)), c >> 8)))"


_ID_CRC = _crc("list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))")


def _le(x: str, n: int) -> str:
    return " || ".join(f"printf('%02X', ({x}) >> {8 * i} & 255)" for i in range(n))


MEDIA = f"""with {_CRC_TABLE}, b as (select doc_id, strlen(coalesce(text, '')) as n, hex(encode(coalesce(text, ''))) as h from documents), p as (select doc_id, n, cast(greatest(1, (n + 575) // 576) * 576 as bigint) as m, h from b),
  f as (select doc_id, n, m, h || repeat('FF', cast(m - n as int)) as h from p), w as (select *, '52494646' || {_le('m + 36', 4)} || '57415645666D74201000000001000100401F0000401F00000100080064617461' || {_le('m', 4)} || h as wav from f)
  select doc_id, n as n_bytes, m as payload_bytes, sha256(unhex(h)) as payload_sha256, cast({_crc("list_transform(range(0, 32), lambda i: cast('0x' || substr(h, cast(2 * (m - 32 + i) + 1 as int), 2) as bigint))")} as bigint) as tail_crc32, m + 44 as media_bytes, sha256(unhex(wav)) as media_sha256 from w, tb"""

_LEAF = """h as (select coalesce(page_id // {per}, 0) as file, page_id % {per} as slot, page_id, 'WARC/1.0\\r\\nWARC-Type: response\\r\\nWARC-Record-ID: <urn:page:' || page_id || '>\\r\\nWARC-Target-URI: ' || coalesce(url, '') || '\\r\\nContent-Type: text/html\\r\\nContent-Length: ' || strlen(coalesce(html, '')) || '\\r\\n\\r\\n' || coalesce(html, '') || '\\r\\n\\r\\n' as x from {src})""".replace("\\r\\n", "' || chr(13) || chr(10) || '")


def _leaves(name: str, src: str) -> str:
    return f"""{name}0 as (with {_LEAF.format(per=warc.RECORDS_PER_FILE, src=src)} select file, slot, page_id, strlen(x) as length, sha256(x) as record_sha256, count(*) as copies from h group by all),
  {name} as (select *, lower(lpad(printf('%X', slot), 3, '0')) || left(record_sha256, 2) as path, coalesce(sum(copies) over w, 0) as seq, coalesce(sum(length * copies) over w, 0) as "offset" from {name}0 window w as (partition by file order by slot, record_sha256 rows between unbounded preceding and 1 preceding)),
  {name}d as (select file, path, sha256(coalesce(cast(page_id as varchar), '') || ':' || length || ':' || copies || ':' || record_sha256) as d from {name})"""


_REPLICA = "(select page_id, url, case when page_id % 97 = 0 then html || '!' when page_id % 131 = 3 then reverse(html) else html end as html from pages where page_id % 61 <> 7 union all select page_id + 10000000, url, html from pages where page_id % 89 = 5)"
_LIMBS = " || ':' || ".join(f"bit_xor(cast('0x' || substr(d, {1 + 15 * i}, 15) as bigint))" for i in range(4))
FIXITY = f"""with {_leaves('a', 'pages')}, {_leaves('b', _REPLICA)},
  l5 as (select file, path, sha256({_LIMBS} || ':' || count(*)) as digest from ad group by 1, 2), """ + ", ".join(
    f"l{d} as (select file, left(path, {d}) as path, sha256(string_agg(path || ':' || digest, ' ' order by path)) as digest from l{up} group by 1, 2)" for up, d in zip(warc.LEVELS, warc.LEVELS[1:])
) + """,
  x as (select a.* from a where not exists (select 1 from b where b.page_id = a.page_id and b.record_sha256 = a.record_sha256 and b.copies = a.copies)), y as (select b.* from b where not exists (select 1 from a where b.page_id = a.page_id and b.record_sha256 = a.record_sha256 and b.copies = a.copies)),
  s as (select a.*, case when x.page_id is null then 'ok' when y.page_id is null then 'missing' else 'corrupt' end as status from a left join x on x.page_id = a.page_id and x.record_sha256 = a.record_sha256 left join y on y.page_id = x.page_id union all select y.*, 'extra' from y where y.page_id not in (select page_id from x))
  select page_id, s.file, cast(seq as bigint) as seq, cast("offset" as bigint) as "offset", length, copies, record_sha256, l0.digest as file_root, status from s left join l0 on l0.file = s.file"""


def _licences() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    words = ", ".join(f"({i}, {j}, {q(w)})" for i, t in enumerate(licences.ALL) for j, w in enumerate(t.words))
    keys = ", ".join(f"({i}, {at}, {list(k)!r}, {q(k[0])})" for i, t in enumerate(licences.ALL) for at, k in t.key_places())
    about = ", ".join(f"({i}, {q(t.label)}, {str(t.base).lower()}, cast({t.share} as double))" for i, t in enumerate(licences.ALL))
    return f"""with d as (select doc_id, {_WORDS.format('text')} as ws from documents), tw(t, j, w) as (values {words}), ky(t, pos, ks, k0) as (values {keys}), tp(t, label, base, need) as (values {about}),
  ps as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from d), df as (select w, count(distinct doc_id) as c from ps where w in (select w from tw) group by 1), n as (select count(*) as n from documents),
  idf as (select tw.*, ln((n + 1) / (coalesce(c, 0) + 1)) + 0.001::double as idf from tw left join df using (w), n), rk as (select *, row_number() over (partition by t order by idf desc, j) as r from idf), an as (select t, j, w, idf / sum(idf) over (partition by t) as share from rk where r <= {licences.ANCHORS}),
  st as (select distinct ps.doc_id, ky.t, ps.i - ky.pos as s from ps join ky on ky.k0 = ps.w where ps.i >= ky.pos), ok as (select st.* from st where not exists (select 1 from ky join d on d.doc_id = st.doc_id where ky.t = st.t and list_slice(d.ws, cast(st.s + ky.pos + 1 as int), cast(st.s + ky.pos + len(ky.ks) as int)) <> ky.ks)),
  wt as (select ok.doc_id, ok.t, ok.s, least(1.0, sum(case when ps.w = an.w then an.share else 0 end)) as weight from ok join an on an.t = ok.t left join ps on ps.doc_id = ok.doc_id and ps.i = ok.s + an.j group by 1, 2, 3), pl as (select wt.*, label, base from wt join tp using (t) where weight >= need - 1e-9),
  g as (select doc_id, count(*) filter (base) as n_base, min(s) filter (base) as first_word, max(s) filter (base) as last_word, string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, round(max(weight), 6) as score from pl group by 1)
  select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score from d left join g using (doc_id)"""


LICENCES = _licences()

_W = substrings.WINDOW
SUBSTRINGS = f"""with d as (select doc_id, {_SPACED.format("coalesce(text, '')")} as ws from documents), w as (select doc_id, i, md5(array_to_string(list_slice(ws, cast(i + 1 as int), cast(i + {_W} as int)), ' ')) as k from (select doc_id, ws, unnest(range(0, len(ws) - {_W - 1})) as i from d where len(ws) >= {_W})),
  f as (select k, min(doc_id) as first from w group by 1), h as (select w.doc_id, w.i from w join f using (k) where f.first < w.doc_id), g as (select distinct doc_id, unnest(range(i, i + {_W})) as j from h), p as (select doc_id, unnest(ws) as x, generate_subscripts(ws, 1) - 1 as j from d),
  r as (select p.doc_id, count(g.j) as n, coalesce(string_agg(x, ' ' order by p.j) filter (g.j is null), '') as kept from p left join g on g.doc_id = p.doc_id and g.j = p.j group by 1)
  select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join r using (doc_id)"""

_B = decontaminate.WINDOW
DECONTAMINATION = f"""with d as (select doc_id, {_WORDS.format('text')} as ws from documents), b as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS.format('text')} as ws from benchmark),
  v as (select distinct item, cast(least(len(ws), {_B}) as int) as n, array_to_string(list_slice(ws, cast(i + 1 as int), cast(i + {_B} as int)), ' ') as k from (select item, ws, unnest(range(0, greatest(1, len(ws) - {_B - 1}))) as i from b where len(ws) > 0)), z as (select distinct n from v),
  w as (select doc_id, i, n, array_to_string(list_slice(ws, cast(i + 1 as int), cast(i + n as int)), ' ') as k from (select doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) as i from d, z where len(ws) >= n)), m as (select doc_id, i, w.n, item from w join v on v.n = w.n and v.k = w.k),
  h as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from m) group by 1), t as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by 1)
  select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join h using (doc_id) left join t using (doc_id)"""

LM_BASE = f"""with {_CRC_TABLE}, d as (select doc_id, {_ID_CRC} % 7 = 2 as held_out, list_append({_SPACED.format(_LOWER)}, ' ') as ws from documents, tb), p as (select doc_id, held_out, unnest(ws) as w from d), c as (select w, count(*) as c from p where not held_out group by 1), n as (select sum(c) as n, count(*) as v from c)
  select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, cast(any_value(n) as bigint) as train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 6) as base_score from p left join c using (w), n group by 1, 2"""

_K = langid.PROFILE
LANGUAGE = f"""with {_CRC_TABLE}, d as (select doc_id, lang, text, {_ID_CRC} % 4 = 2 as held_out from documents, tb), w as (select doc_id, lang, held_out, unnest(list_filter(string_split(regexp_replace(lower(replace(coalesce(text, ''), 'Σ', 'σ')), '[^\\p{{L}}]+', ' ', 'g'), ' '), lambda x: x <> '')) as w from d),
  c as (select doc_id, lang, held_out, list_append(list_prepend(cast(32 as bigint), list_transform(string_split(w, ''), lambda x: cast(unicode(x) as bigint))), cast(32 as bigint)) as s from w),
  g as (select doc_id, lang, held_out, unnest(list_concat(list_slice(s, 2, -2), list_concat(list_transform(range(1, len(s)), lambda i: (s[i] << 21) | s[i + 1]), list_transform(range(1, len(s) - 1), lambda i: (s[i] << 42) | (s[i + 1] << 21) | s[i + 2])))) as g from c),
  dc as (select doc_id, any_value(lang) as lang, any_value(held_out) as held_out, g, count(*) as n from g group by doc_id, g), lc as (select lang, g, sum(n) as n from dc where not held_out and lang is not null group by 1, 2),
  lp as (select lang, g, row_number() over (partition by lang order by n desc, g) - 1 as r from lc qualify r < {_K}), dp as (select doc_id, g, row_number() over (partition by doc_id order by n desc, g) - 1 as r from dc qualify r < {_K}),
  ls as (select distinct lang from lp), pr as (select dp.doc_id, ls.lang, sum(case when lp.r is null then {_K} else least(abs(lp.r - dp.r), {_K}) end) as far, count(*) as n from dp cross join ls left join lp on lp.lang = ls.lang and lp.g = dp.g group by 1, 2),
  sc as (select doc_id, lang, cast(far as double) / ({_K} * n) as dist from pr), best as (select doc_id, arg_min(lang, (dist, lang)) as lang, min(dist) as dist from sc group by 1)
  select d.doc_id, held_out, coalesce(best.lang, 'und') as lang_pred, coalesce(1 - dist, 0.0::double) as score from d left join best using (doc_id)"""

URL_RULES = r"""with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
  r(said, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')), f as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(said, length(h || p)) as said from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1)
  select page_id, host, path, rule, said from u left join f using (page_id)"""

NEAR = f"""with recursive d as (select doc_id, {_SPACED.format(_LOWER)} as ws from documents), s as (select distinct doc_id, array_to_string(list_slice(ws, cast(i + 1 as int), cast(i + 5 as int)), ' ') as k from (select doc_id, ws, unnest(range(0, greatest(1, len(ws) - 4))) as i from d where len(ws) > 0)), n as (select doc_id, count(*) as n from s group by 1),
  c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2), l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)), e as (select x, y from l union select y, x from l),
  r(x, y) as (select x, y from e union select r.x, e.y from r join e on e.x = r.y), m as (select x, min(y) as y from r group by 1)
  select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) as component_id, d.doc_id <= coalesce(m.y, d.doc_id) as kept from d left join n using (doc_id) left join m on m.x = d.doc_id"""

HARD_NEGATIVES = """with r as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
  s as (select distinct on (a.vec_id, b.vec_id) a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score from r a, r b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
  p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
  n as (select p.*, other as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, other) as rank
    from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score qualify rank <= 5)
  select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n"""

RANKED = f"""with d as (select doc_id, {_WORDS.format('text')} as ws from documents), g as (select count(*) as n, cast(sum(len(ws)) as bigint) as l from d where len(ws) > 0),
  t as (select doc_id, w, count(*) as tf from (select doc_id, unnest(ws) as w from d) group by 1, 2), f as (select w, count(*) as df from t group by 1),
  v as (select w, cast(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) as bigint) as weight from f, g),
  q as (select distinct item_id, unnest({_WORDS.format('text')}) as w from benchmark),
  m as (select doc_id, 50 + (50 * len(ws) * g.n) // g.l as m from d, g where len(ws) > 0),
  s as (select item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score from q join v using (w) join t using (w) join m using (doc_id) group by 1, 2)
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0 qualify rank <= 50"""

ORACLE = {
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_ranked_search": RANKED,
    "op2_fixity_audit": FIXITY,
    "op3_licence_scan": LICENCES,
    "op4_substring_dedup": SUBSTRINGS,
    "op5_decontamination": DECONTAMINATION,
    "op7_language_id": LANGUAGE,
    "op10_near_duplicates": NEAR,
    "media_base": MEDIA,
    "lm_base": LM_BASE,
    "url_rules": URL_RULES,
}
