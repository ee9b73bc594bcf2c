"""The registered queries on conversations and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.conversation_repair import repair_digest

    return repair_digest(conversations(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.llm.prefix_trie import conversation_trie

    return conversation_trie(conversations(spark, sf_dir))


QUERIES = {
    "op11_conversation_repair": op11_conversation_repair,
    "op13_prefix_trie": op13_prefix_trie,
}


def crc32_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters."""
    byte = "lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    step = f"list_reduce(list_prepend(xor(c, b), range(8)), {byte})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: {step}), 4294967295)"


SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _label(cost: str, letter: str, line: str, before: str) -> str:
    return f"case when {before} is not null then {{'cost': {before}.cost + {cost}, 'audit': {before}.audit || '{letter}', 'said': {before}.said || {line}}} end"


def _option(letter: str, role: str, before: str, when: str = "not gone") -> str:
    cost = "extra" if letter == "K" else "extra + 1"
    return f"case when {when} then {_label(cost, letter, f'chr(10) || {role} || chr(58) || text', before)} end"


_DELETED = {s: _label("2", "D", "''", f"r.{s}") for s in "bsua"}
_TO_USER = [_option("K", "role", f"r.{s}", "not gone and initial = 'u'") for s in "bsa"] + [_option("R", "'user'", f"r.{s}") for s in "bsa"]
_TO_REPLY = [_option("K", "role", "r.u", "not gone and initial = 'a'"), _option("R", "'assistant'", "r.u")]

ORACLES = {
    # The cheapest edits by state (b: nothing yet, s: system, u: user, a: assistant), turn after turn. An inserted turn
    # (5) is never cheaper than deleting a neighbour (2), so the search over edits is whole without it.
    "op11_conversation_repair": f"""
with recursive c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when kind = 3 then [0, 1] else [0] end) as copy from c where kind <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from d),
e as (
  select *, left(role, 1) as initial, rtrim(text, {SPACES}) as bare,
    row_number() over (partition by conv_id, role, text order by i) > 1 as again from o),
f as (
  select *, case when bare = '' then 'b' when again then 'd' when right(bare, 1) not in ('.', '!', '?') then 't' else 'o' end as fault,
    lag(initial) over (partition by conv_id order by i) as before from e),
g as (select *, fault in ('b', 'd') as gone, case when fault = 't' then 5 else 0 end as extra from f),
r as (
  select conv_id, 0::bigint as i, {{'cost': 0::bigint, 'audit': '', 'said': ''}} as b,
    null::struct(cost bigint, audit varchar, said varchar) as s, null::struct(cost bigint, audit varchar, said varchar) as u,
    null::struct(cost bigint, audit varchar, said varchar) as a from (select distinct conv_id from conversations)
  union all
  select r.conv_id, g.i, {_DELETED['b']},
    list_min([{_DELETED['s']}, {_option("K", "role", "r.b", "not gone and initial = 's'")}]),
    list_min([{_DELETED['u']}, {', '.join(_TO_USER)}]),
    list_min([{_DELETED['a']}, {', '.join(_TO_REPLY)}])
  from r join g on r.conv_id is not distinct from g.conv_id and g.i = r.i + 1),
z as (select conv_id, arg_max(list_min([b, a]), i) as best from r group by conv_id),
n as (
  select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (where fault = 'b') as blank,
    count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
    count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from g group by conv_id)
select z.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, best.cost::bigint as cost, best.audit as audit,
  sha256(substr(best.said, 2)) as repaired_sha256
from z left join n on z.conv_id is not distinct from n.conv_id""",
    "op13_prefix_trie": f"""
with o as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as rank
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as family, {crc32_sql("conv_id::varchar")} % 9 as h from o group by conv_id),
heads as (select c.conv_id, o.rank, role, text from c join o on o.conv_id = c.family and o.rank < c.h),
own as (select o.conv_id, o.rank + 9 as rank, role, text from c join o on o.conv_id = c.conv_id and o.rank >= c.h),
turns as (select * from heads union all select * from own),
s as (
  select conv_id, coalesce(list({{'role': role, 'text': text}} order by rank) filter (where rank is not null), []) as said
  from c left join turns using (conv_id) group by conv_id),
p as (select conv_id, said, unnest(range(len(said) + 1)) as depth from s),
m as (
  select said[:depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(said) = depth) as ends
  from p group by said[:depth], depth),
k as (select path[:depth - 1] as path, depth - 1 as depth, count(*) as n_children from m where depth > 0 group by path[:depth - 1], depth - 1),
w as (
  select m.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * strlen(path[depth].text) end as saved
  from m left join k using (path, depth)),
u as (select path, depth, saved, n_children, unnest(range(depth + 1)) as above from w),
t as (
  select path[:above] as path, above as depth, count(*) filter (where n_children = 0) as n_leaves, sum(saved) as saved_tokens
  from u group by path[:above], above)
select w.conv_id, w.depth, q.conv_id as parent_conv_id, w.n_convs, w.n_children, t.n_leaves, t.saved_tokens::bigint as saved_tokens,
  sha256(coalesce(w.ends, '')) as ends_sha256
from w join t using (path, depth) left join w q on w.depth > 0 and q.depth = w.depth - 1 and q.path = w.path[:w.depth - 1]""",
}
