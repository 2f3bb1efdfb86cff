"""The SQL of exam_queries for DuckDB.

The fold over torn lines is a list_reduce whose elements carry the lines after them; the rewrites
have no look-ahead there, so what follows is captured and put back.
"""

from __future__ import annotations

from learnspark.functions.patterns import COST_FLOW, FIRST_PHASE, IN_TRANSIT, NO_REASON, OTHER, RULES
from learnspark.plans.record_sql import FOOTERS
from learnspark.sources.torn import ACCOUNTING, CELLS, FRAGMENTS, GAPS, LATIN, MARKS, OTHER_WORDS, SHEET, SYLLABLES

_LIST = "[" + ", ".join(f"'{x}'" for x in FRAGMENTS) + "]"
TORN = f"torn AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda w: w <> ''), lambda w: replace({_LIST}[(ascii(w) + 3 * length(w)) % {len(FRAGMENTS)} + 1], '~', w)) AS lines FROM documents)"

# How torn lines of each kind look, and ties that go when a clause is made.
_KIND = r"""CASE WHEN line = '(' THEN 'open' WHEN line = ')' THEN 'close' WHEN regexp_full_match(line, '20[×xX]\d{1,2}') THEN 'year'
  WHEN regexp_full_match(line, '\d{1,3}(,\d{3})+|\d{3,}') THEN 'amount' WHEN regexp_matches(line, '^[년월일주원%]') THEN 'unit' WHEN regexp_full_match(line, '\d{1,2}') THEN 'day'
  WHEN line IN ('W', '￦', '₩') THEN 'currency' WHEN line IN ('과', '.', ',', ';') THEN 'link' ELSE 'text' END"""
_LOOSE = r"(trim(s.done[k]) IN ('년과', '년에', '년의', '각각', '각각과', '과', '(', ')') OR starts_with(trim(s.done[k]), '(') AND ends_with(trim(s.done[k]), ')') AND NOT regexp_matches(s.done[k], '20[×xX]'))"
_TAIL = "s.done[len(s.done)]"


def _glued(done: str, text: str, space: str = " ") -> str:
    return f"(CASE WHEN len({done}) = 0 THEN [{text}] ELSE list_append({done}[1:len({done}) - 1], trim({done}[len({done})] || '{space}' || {text})) END)"


_FIRM = f"s.done[1:coalesce(list_max(list_filter(range(1, len(s.done) + 1), lambda k: NOT {_LOOSE})), 0)]"
_Y1, _Y2 = "s.years[len(s.years) - 1]", "s.years[len(s.years)]"
_MONEY = "x.line || 'W'"
_WAIT = "len(s.years) > 1 AND len(s.done) > 0"
_TIED = f"{_WAIT} AND x.kind NOT IN ('open', 'year', 'amount') AND NOT (x.kind = 'close' AND s.open) AND right(trim({_TAIL}), 2) IN ('년과', '년에', '년의')"
_CASE = f"CASE WHEN right(trim({_TAIL}), 2) = '년의' THEN '의' ELSE '에' END"
_FLUSHED = "CASE WHEN len(s.years) > 0 AND NOT contains(x.line, '년') AND x.line <> '각각' THEN list_append(list_append(s.done, array_to_string(s.years, ' ')), x.line) ELSE list_append(s.done, x.line) END"
_DATE = "len(s.years) > 0 AND x.kind = 'day' AND x.k1 = 'day'"
_TIES = " OR ".join(f"contains({_TAIL}, '{t}')" for t in ("년과", "년에", "각각", "년의"))
#: (condition, done, years, open, skip) by the first that holds.
_RULES = (
    ("s.skip > 0", "s.done", "s.years", "s.open", "s.skip - 1"),
    ("x.kind = 'open'", "s.done", "s.years", "true", "0"),
    ("x.kind = 'close' AND s.open", "s.done", "s.years", "false", "0"),
    ("x.kind = 'year'", "s.done", "list_append(s.years, regexp_replace(x.line, '[xX]', '×'))", "s.open", "0"),
    (_TIED, f"list_append({_glued(f'({_FIRM})', f"('(' || {_Y1} || ')년과 (' || {_Y2} || ')년' || {_CASE})")}, x.line)", "CAST([] AS VARCHAR[])", "s.open", "0"),
    ("x.kind = 'unit' AND len(s.years) > 0", "list_append(s.done, s.years[1] || '년' || CASE WHEN x.line IN ('년', '월') THEN '' WHEN starts_with(x.line, '일') THEN ' 1월 2일' ELSE ' ' || x.line END)", "s.years[2:]", "false", "0"),
    (_DATE, "list_append(s.done, s.years[1] || '년 ' || x.line || '월 ' || x.n1 || '일' || CASE WHEN x.k2 = 'currency' THEN 'W' ELSE '' END)", "s.years[2:]", "s.open", "CASE WHEN x.k2 = 'currency' THEN 2 ELSE 1 END"),
    ("x.kind = 'currency' AND len(s.done) > 0", f"list_append(s.done[1:len(s.done) - 1], rtrim({_TAIL}) || 'W')", "s.years", "s.open", "0"),
    (f"x.kind = 'amount' AND {_WAIT} AND ({_TIES})", _glued(f"({_FIRM})", f"('(' || {_Y1} || ')년과 (' || {_Y2} || ')년에 각각 ' || {_MONEY})"), "CAST([] AS VARCHAR[])", "s.open", "CASE WHEN x.k1 = 'currency' THEN 1 ELSE 0 END"),
    ("x.kind = 'amount' AND x.jump > 0 AND len(s.done) > 0", _glued(f"({_FIRM})", f"('(' || x.y1 || ')년과 (' || x.y2 || ')년에 각각 ' || {_MONEY})"), "s.years", "s.open", "x.jump"),
    ("x.kind = 'amount'", _glued("s.done", "(x.line || CASE WHEN x.k1 = 'currency' THEN 'W' ELSE '' END)"), "s.years", "s.open", "CASE WHEN x.k1 = 'currency' THEN 1 ELSE 0 END"),
    (f"x.kind = 'link' AND len(s.done) > 0 AND x.line = '과' AND ends_with({_TAIL}, '각각')", "s.done", "s.years", "s.open", "0"),
    ("x.kind = 'link' AND len(s.done) > 0", f"list_append(s.done[1:len(s.done) - 1], {_TAIL} || x.line)", "s.years", "s.open", "0"),
    ("true", _FLUSHED, "CASE WHEN NOT contains(x.line, '년') AND x.line <> '각각' THEN CAST([] AS VARCHAR[]) ELSE s.years END", "s.open", "0"),
)


def _field(k: int) -> str:
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {r[k]}" for r in _RULES) + " END"


_STATE = "'line': '', 'kind': '', 'n1': '', 'k1': '', 'k2': '', 'y1': '', 'y2': '', 'jump': 0"
REJOINED = f"""
WITH {TORN},
rows_ AS (SELECT doc_id, i, line, {_KIND} AS kind FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM torn)),
near AS (SELECT *, lead(line) OVER w AS n1, lead(kind) OVER w AS k1, lead(kind, 2) OVER w AS k2,
                min(i) FILTER (kind = 'year') OVER a AS ny, coalesce(min(i) FILTER (kind NOT IN ('year', 'link')) OVER a, 1000000000) AS other
         FROM rows_ WINDOW w AS (PARTITION BY doc_id ORDER BY i), a AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
ahead AS (SELECT *, CASE WHEN k1 = 'currency' THEN lead(ny) OVER w ELSE ny END AS a1, CASE WHEN k1 = 'currency' THEN lead(other) OVER w ELSE other END AS stop
          FROM near WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
full_ AS (SELECT a.*, CASE WHEN a.kind = 'amount' AND f.ny < a.stop THEN f.ny - a.i ELSE 0 END AS jump, f.line AS l1, f.ny AS a2 FROM ahead a LEFT JOIN near f ON f.doc_id = a.doc_id AND f.i = a.a1),
items AS (SELECT f.doc_id, list({{'done': CAST([] AS VARCHAR[]), 'years': CAST([] AS VARCHAR[]), 'open': false, 'skip': 0, 'line': f.line, 'kind': f.kind, 'n1': coalesce(f.n1, ''), 'k1': coalesce(f.k1, ''), 'k2': coalesce(f.k2, ''),
                         'y1': regexp_replace(coalesce(l1, ''), '[xX]', '×'), 'y2': regexp_replace(coalesce(g.line, ''), '[xX]', '×'), 'jump': CAST(f.jump AS INT)}} ORDER BY f.i) AS frags
          FROM full_ f LEFT JOIN rows_ g ON g.doc_id = f.doc_id AND g.i = f.a2 GROUP BY 1),
folded AS (SELECT doc_id, list_reduce(frags, lambda s, x: {{'done': {_field(1)}, 'years': {_field(2)}, 'open': {_field(3)}, 'skip': CAST({_field(4)} AS INT), {_STATE}}},
                  {{'done': CAST([] AS VARCHAR[]), 'years': CAST([] AS VARCHAR[]), 'open': false, 'skip': 0, {_STATE}}}) AS s FROM items)
SELECT doc_id, CAST(coalesce(len(lines), -1) AS INT) AS n_lines, CAST(len(all_) AS INT) AS n_left, CASE WHEN lines IS NOT NULL THEN array_to_string(all_, chr(10)) END AS text
FROM (SELECT t.doc_id, lines, coalesce(CASE WHEN len(s.years) > 0 THEN list_append(s.done, array_to_string(s.years, ' ')) ELSE s.done END, []) AS all_ FROM torn t LEFT JOIN folded USING (doc_id))
"""

_Y = r"20[×xX](\d{1,2})"
_D = r"\s+(\d{1,2})"
#: The rewrites, what follows captured.
_REWRITES = (
    (r"\(\s*\)\s*([년월일과에의.])", r"\1"),
    (r"년\s*과\s*년\s*에\s*\(", "("),
    (r"년\s*과\s*년\s*의\s*\(", "("),
    (rf"(?i)년\s*과\s*년\s*에\s*각각\s*(?:과\s*)?{_Y}\s+{_Y}\s+(\d{{1,3}}(?:,\d{{3}})*)\s*W?", r"(20×\1)년과 (20×\2)년에 각각 \3W"),
    (rf"(?i)년\s*과\s*년\s*의(\s*[^.?]{{0,60}}?)\s+{_Y}\s+{_Y}", r"(20×\2)년과 (20×\3)년의\1"),
    (rf"(?i){_Y}년\s*월\s*일(?:부터|에)?[^0-9]{{0,30}}(\d{{1,2}}){_D}", r"20×\1년 \2월 \3일"),
    (r"(^|[^0-9])년\s*월\s*일\s*(까지|에|과)", r"\1\2"),
    (r"(^|[^0-9])년\s*월\s*일\s*(까지|에|과)", r"\1\2"),
    (rf"(?i)월\s*일\s*과\s*월\s*일\s*에\s+[\d,]+W?\s*(\d{{1,2}}){_D}{_D}{_D}", r"\1월 \2일 과 \3월 \4일"),
    (rf"(?i)(20[×xX]\d{{1,2}}{_D}{_D}\s*)(W)$", "\\1\x01\\4"),
    (rf"(?i)\.?\s*{_Y}{_D}{_D}\s*W", r"20×\1년 \2월 \3일"),
    ("\x01", ""),
    (rf"(?i){_Y}{_D}{_D}\s+", r"20×\1년 \2월 \3일 "),
    (rf"{_Y}\s+년{_D}\s+월{_D}\s+일", r"20×\1년 \2월 \3일"),
    (rf"{_Y}\s+월\s+일", r"20×\1년 1월 2일"),
)
_text = "v0 AS (SELECT doc_id, array_to_string(lines, ' ') AS t FROM torn)"
for _k, (_p, _r) in enumerate(_REWRITES):
    _text += f",\nv{_k + 1} AS (SELECT doc_id, regexp_replace(t, '{_p}', '{_r}', 'g') AS t FROM v{_k})"
RESTRUCTURED = rf"""
WITH {TORN}, {_text}
SELECT doc_id, trim(regexp_replace(CASE WHEN regexp_matches(t, '20[×xX]\d{{1,2}}\s*년\s*\d{{1,2}}\s*월\s*\d{{1,2}}\s*일') THEN regexp_replace(t, '년\s*월\s*일\s*', '', 'g') ELSE t END,
            '(\?)\s*년\s+(?:20[×xX]\d{{1,2}}\s*년\s*){{2,4}}20[×xX]\d{{1,2}}\s*$', '\1')) AS text FROM v{len(_REWRITES)}
"""


_NL, _SPACE, _EMPTY = "chr(10)", "' '", "''"
_SPLIT_WORDS = r"list_filter(regexp_split_to_array(text, '[ \n\t]+'), lambda v: v <> '')"


def _word(k: int) -> str:
    return f"w[(7 * {k}) % len(w) + 1]"


def _won(k: int) -> str:
    n = f"length({_word(k)})"
    return f"('W' || ({n} % 9 + 1) || ',' || lpad(CAST((37 * {n} + {k}) % 1000 AS VARCHAR), 3, '0'))"


def _second_won(k: int) -> str:
    return _won(k + 5)


def _marked(*parts) -> str:
    return " || ".join(f"'{m}' || " + " || ".join(p if isinstance(p, str) else p(k) for p in parts) for k, m in enumerate(MARKS, 1))


def _at(k: int) -> str:
    return f"' {MARKS[k - 1]} ' || {_won(k)}"


_LAYOUTS = (
    f"'? 20×1 20x2' || {_NL} || {_marked(_SPACE, _won, _NL, _second_won, _NL)}",
    f"'?' || {_NL} || '(A) (B)' || {_NL} || {_marked(_SPACE, _word, _NL, _won, _NL)}",
    f"'?' || {_NL} || {_marked(_NL, _word, _SPACE, _word, _NL, _SPACE, _word, _NL)}",
    f"'? ' || {_marked(_SPACE, _word, _SPACE, _SPACE, _word, _SPACE)}",
    f"'?' || {_at(1)} || {_NL} || {_at(2)} || {_NL} || {_at(3)} || {_at(4)} || {_NL} || {_at(5)}",
    f"'? # ' || {_word(1)} || ' . # ' || {_word(2)} || ' # ' || {_word(3)} || '# ' || {_word(4)} || ' # ' || {_word(5)}",
    f"'? (단, ' || {_word(1)} || ')' || {_NL} || '① ㄱ, ' || {_word(2)} || {_NL} || '② ㄴ ' || {_word(3)} || {_NL} || '③ ㄱ, ㄴ ④ ㄴ, ㄷ ⑤ ㄷ'",
    "'?'",
    f"'? 액면가치 3% 4% 5% 6% 7% 8% 9% 10% 0.9709 0.9615 0.9524 0.9434 0.9346 1.111 ' || {_word(1)} || ' 0.25 0.5 0.125 0.0625'",
    f"'? ① ' || {_word(1)} || ' ② ' || {_word(2)}",
    f"'? 년 20×1년 20×2년 20×1년 20x2' || {_NL} || '①' || {_won(1)} || ', ' || {_won(2)} || {_NL} || '가나다라 ' || {_word(1)} || {_NL} || "
    + " || ".join(f"'{m} 당기순이익이 증가하고 자산과 부채는 변동하지 않는다 ' || {_word(k)} || {_NL}" for k, m in enumerate(MARKS[1:], 2)),
)
_LAYOUT = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_LAYOUTS))
BODIES = f"""bodies AS (SELECT doc_id, (doc_id % 40 + 41) || '. ' || text || CASE doc_id % {len(_LAYOUTS)} {_LAYOUT} END AS body
FROM (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN len(w) > 0 THEN w ELSE ['none'] END AS w FROM (SELECT doc_id, text, {_SPLIT_WORDS} AS w FROM documents)))"""


def _let(value: str, name: str, then: str) -> str:
    return f"list_transform([{value}], lambda {name}: {then})[1]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _bare(x: str, marks: str) -> str:
    return f"regexp_replace({x}, '^[ {marks}]+|[ {marks}]+$', '', 'g')"


def _one_line(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _clean(x: str) -> str:
    for pattern in FOOTERS:
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    return _strip(x)


_AMOUNT = r"W[\d,]+(?:\.\d+)?"
_CELL = rf"(?i)^{_AMOUNT}$"
_PAIR = r"^W[\d,]+,?\s*W[\d,]+$"
_WORDS = "[가-힣]{4,}"


def _is_cell(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{_CELL}'), false)"


def _columns(cells: str) -> str:
    """The cells of a choice as one text; names are the column `names`."""
    some = f"list_filter(list_transform({cells}, lambda c1: {_one_line('c1')}), lambda c2: c2 <> '')"
    amounts = r"regexp_extract_all(c3[1], 'W[\d,]+')"
    split = f"CASE WHEN len(c3) = 1 AND NOT regexp_matches(c3[1], '{_WORDS}') AND len({amounts}) >= 2 THEN {amounts}[1:CASE WHEN len(names) > 0 THEN len(names) ELSE 1000000 END] ELSE c3 END"
    named = "CASE WHEN least(len(c4), len(names)) >= 3 THEN names[1] || ' ' || c4[1] || ', ' || names[2] || ' ' || c4[2] || ', ' || names[3] || ' ' || c4[3] WHEN least(len(c4), len(names)) = 2 THEN names[1] || ' ' || c4[1] || ', ' || names[2] || ' ' || c4[2]"
    named += f" WHEN len(c4) >= 2 AND NOT regexp_matches(array_to_string(c4, ' '), '{_WORDS}') THEN c4[1] || ', ' || c4[2] ELSE array_to_string(c4, ' ') END"
    return _let(some, "c3", _let(split, "c4", named))


def _five(x: str) -> str:
    return _let(x, "f1", "CASE WHEN len(f1) >= 5 THEN f1[1:5] END")


def _kept(x: str) -> str:
    return _five(f"list_filter(list_transform({x}, lambda k1: {_clean('k1')}), lambda k2: k2 <> '' AND length(k2) <= 600)")


def _each(items: str, name: str, then: str) -> str:
    return f"list_transform({items}, lambda {name}: {then})"


_END = "right(flat, 120)"
_FIXED = rf"""CASE WHEN regexp_matches(flat, '(?i)\(A\).*\(B\)') THEN ['(A)', '(B)'] WHEN len(regexp_extract_all({_END}, '할인액')) >= 2 AND contains({_END}, '처분손실') THEN ['할인액', '처분손실']
 WHEN contains({_END}, '법인세비용') AND contains({_END}, '이연법인세') THEN ['법인세비용', '이연법인세자산', '이연법인세부채'] ELSE [] END"""
_STOPS = [f"(?:\\s*[{MARKS[k + 1 :]}]|$)" if MARKS[k + 1 :] else "$" for k in range(5)]
_INLINE = "[" + ", ".join(_one_line(f"regexp_extract(lines[1], '{m}\\s*(.+?){_STOPS[k]}', 1)") for k, m in enumerate(MARKS)) + "]"
_BELOW = f"[l[2:], CASE WHEN {_is_cell('lines[i + 1]')} THEN lines[i + 1] ELSE '' END]"
_MULTI = f"list_filter(list_transform(lines, lambda l, i: CASE WHEN regexp_matches(l, '^[{MARKS}]') THEN {_clean(_columns(_BELOW))} END), lambda z: z <> '')"
_BLOCKS = _each("parts", "b", f"CASE WHEN {_is_cell('b[2]')} THEN {_columns('b')} ELSE {_one_line('array_to_string(b, chr(32))')} END")
_MARKED_LINES = _each(rf"list_filter(every, lambda e: regexp_matches(e, '^[{MARKS}]\s*.'))", "e", _clean(_columns("[e[2:]]")))
_WITH_AMOUNT = rf"list_filter({_MARKED_LINES}, lambda e: contains(e, 'W') OR regexp_matches(e, '\d{{1,3}}(?:,\d{{3}})+'))"
_ONE = "replace(body, chr(10), ' ')"
_ANYWHERE = _each(rf"regexp_extract_all({_ONE}, '[{MARKS}]\s*((?:W[\d,]+(?:\s*,?\s*)?)+)', 1)", "e", _one_line(_columns("[e]")))
_HASHES = _each(rf"list_filter({_each(f'string_split({_ONE}, chr(35))[2:]', 'h', _strip('h'))}, lambda h: length(h) BETWEEN 1 AND 220)", "h", _one_line(_bare("h", ".")))
_MISREAD = _each(rf"regexp_extract_all(after_, '[{MARKS}]?\s*([ㄱ-ㅎㅁ]|그|L|드|근|I|II|H)[^{MARKS}]{{0,120}}', 1)", "h", _one_line("h"))
_LETTERS = _each(rf"regexp_extract_all(after_, '[{MARKS}]\s*([ㄱ-ㅎㅁ][^{MARKS}]{{0,120}})', 1)", "h", _one_line("h"))
_TAIL_LINE = "replace(CASE WHEN tail <> '' THEN tail ELSE body END, chr(10), ' ')"
_SENTENCES = _each(rf"string_split(regexp_replace({_TAIL_LINE}, '([.:])\s+', '\1' || chr(1), 'g'), chr(1))", "h", _bare("h", ".:"))
_LONG = _each(f"list_filter({_SENTENCES}, lambda h: length(h) >= 8)", "h", _one_line("h"))
_SIZE = "greatest(1, len(d) // 5)"
_GROUPS = _each(f"range(0, least(len(d), {_SIZE} * 5), {_SIZE})", "h", f"array_to_string(d[h + 1:h + {_SIZE}], ' / ')")
_BOND = _let(r"regexp_extract_all(body, '\d+\.\d{2,4}')", "d", f"CASE WHEN len(d) >= 4 THEN {_five(_GROUPS)} END")
_PAIRS = _each("cells", "g", "CASE WHEN len(g.parts) >= 2 THEN names[1] || ' ' || g.parts[1] || ', ' || names[2] || ' ' || g.parts[2] ELSE g.parts[1] END")
_PER = {
    "grid": f"CASE WHEN len(names) >= 2 AND len(cells) = 5 AND len(cells[1].parts) >= 2 THEN {_PAIRS} END",
    "multicolumn": _five(_MULTI),
    "circled": f"coalesce({_kept(_BLOCKS)}, CASE WHEN len(lines) = 1 THEN {_kept(_INLINE)} END)",
    "won": f"coalesce({_five(_WITH_AMOUNT)}, {_five(_ANYWHERE)})",
    "hash": _five(_HASHES),
    "combination": f"coalesce({_five(_MISREAD)}, {_five(_LETTERS)})",
    "statement": _five(_LONG),
    "bond": rf"CASE WHEN regexp_matches(body, '액면가치|시장이자율|상환가치|연금현재가치|내재이자율|단일금액') AND len(regexp_extract_all(body, '\d+(?:\.\d+)?%')) >= 8 THEN {_BOND} END",
}
_GRID_CELLS = "[" + ", ".join(f"{{'mark': '{m}', 'parts': regexp_extract_all(regexp_extract(tail, '{m}\\s*{_AMOUNT}(?:\\s*\\n\\s*{_AMOUNT})?'), '{_AMOUNT}')}}" for m in MARKS) + "]"
_LONGER = _let(_clean(_one_line("array_to_string(parts[i], ' ')")), "y", f"CASE WHEN regexp_matches(trim(z), '{_PAIR}') AND length(y) > length(z) THEN y ELSE z END")
_WHOLE = f"""CASE WHEN len(parts) = 5 AND len(list_filter(c, lambda z: regexp_matches(trim(z), '{_PAIR}'))) > 0 AND len(list_filter(c, lambda z: length(z) > 25 AND regexp_matches(z, '{_WORDS}'))) >= 3
  THEN list_transform(c, lambda z, i: {_LONGER}) ELSE c END"""
_FOUR = r"년\s+20[×xX]\d{1,2}년\s+20[×xX]\d{1,2}년\s+20[×xX]\d{1,2}년\s+20[×xX]\d{1,2}"
_TRIED = ", ".join(f"{v} AS s_{k}" for k, v in _PER.items())
_FIRST = " ".join(f"WHEN s_{k} IS NOT NULL THEN '{k}'" for k in _PER)
CHOICES = rf"""WITH {BODIES},
b1 AS (SELECT doc_id, body, regexp_extract(body, '^[^{MARKS}]*') AS above FROM bodies),
b2 AS (SELECT *, substr(body, length(above) + 1) AS tail, replace(above, chr(10), ' ') AS flat, regexp_extract({_one_line("body")}, '[?？]\s*(?:\([^)]*\))?\s*(.+)$', 1) AS after_ FROM b1),
b3 AS (SELECT *, regexp_extract_all(regexp_replace(regexp_extract_all(regexp_replace(flat, '(?i)(20[×xX]\d{{1,2}})\s+년', '\1년', 'g'), '{_FOUR}')[-1], '[xX]', '×', 'g'), '20×\d{{1,2}}')[1:2] AS four,
   list_transform(regexp_extract_all(right(above, 200), '20[×xX]\d{{1,2}}'), lambda y: regexp_replace(y, '[xX]', '×')) AS ys,
   list_filter(list_transform(string_split(tail, chr(10)), lambda l: {_strip("l")}), lambda l: l <> '') AS lines, list_filter(list_transform(string_split(body, chr(10)), lambda l: {_strip("l")}), lambda l: l <> '') AS every,
   list_filter({_GRID_CELLS}, lambda g: len(g.parts) > 0) AS cells FROM b2),
b4 AS (SELECT *, CASE WHEN four IS NOT NULL THEN list_transform(four, lambda y: y || '년') WHEN len(list_distinct(ys)) >= 2 THEN list_transform(list_filter(ys, lambda y, i: list_position(ys, y) = i)[1:2], lambda y: y || '년') ELSE {_FIXED} END AS names FROM b3),
ln AS (SELECT doc_id, line, i, sum(CASE WHEN regexp_matches(line, '^[{MARKS}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM b3)),
lb AS (SELECT doc_id, block, left(min_by(line, i), 1) AS mark, list_filter(list(CASE WHEN regexp_matches(line, '^[{MARKS}]') THEN {_strip("line[2:]")} ELSE line END ORDER BY i), lambda l: l <> '') AS own FROM ln WHERE block > 0 GROUP BY 1, 2),
lp AS (SELECT doc_id, list(own ORDER BY block) AS parts, list(mark ORDER BY block) AS marks FROM lb GROUP BY 1),
b5 AS (SELECT b4.*, coalesce(parts, []) AS parts, marks FROM b4 LEFT JOIN lp USING (doc_id)),
b6 AS (SELECT *, {_TRIED} FROM b5),
b7 AS (SELECT *, CASE {_FIRST} END AS strategy, coalesce({", ".join(f"s_{k}" for k in _PER)}, []) AS c FROM b6)
"""
EXAM_CHOICES = CHOICES + f"SELECT doc_id, strategy, array_to_string(cc, chr(10)) AS choices, CAST(len(cc) AS INT) AS n_choices FROM (SELECT doc_id, strategy, {_WHOLE} AS cc FROM b7)"


def _some(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda q: {_strip('q')}), lambda q: q <> '')"


def _cells_of(line: str) -> str:
    gaps = line
    for pattern, new in ((r"\s{2,}|\t", "chr(1)"), (r"(\d)\s(\D)", r"'\1' || chr(1) || '\2'"), (r"(\D)\s(\d)", r"'\1' || chr(1) || '\2'")):
        gaps = f"regexp_replace({gaps}, '{pattern}', {new}, 'g')"
    bars = _some(rf"string_split(regexp_replace({line}, '^\|+|\|+$', '', 'g'), '|')")
    parts = _let(_some(f"string_split({gaps}, chr(1))"), "p", f"CASE WHEN len(p) < 2 AND contains({line}, '|') THEN {bars} ELSE p END")
    return f"CASE WHEN contains({line}, chr(9)) THEN {_some(f'string_split({line}, chr(9))')} ELSE {parts} END"


_QUESTION = rf"^(?:\d{{1,2}}\.|[{MARKS}])"
_ENTRY, _FACTOR = r"regexp_matches(line, '^\((?:차변|대변)\)')", r"regexp_matches(line, '\d+\.\d{3,4}')"
_HEADER = rf"""NOT regexp_matches(line, '[?？]') AND NOT regexp_matches(replace(line, ' ', ''), '^(?:년\s*)?(?:20[×xX]\d{{1,2}}\s*년\s*){{1,4}}20[×xX]\d{{1,2}}\s*$') AND (length(line) <= 140 OR starts_with(line, '(차변)'))
 AND ({_ENTRY} OR regexp_matches(line, '차변|대변|구분|일자|적요|예산|실제|단일금액|정상연금|액면가치|시장이자율|상환가치|연금현재가치') AND len(cells) >= 2 OR len(cells) >= 3 AND regexp_matches(line, '\d') OR {_FACTOR})"""
_DATA = rf"{_ENTRY} OR {_FACTOR} OR len(cells) >= 2 AND regexp_matches(line, '\d')"
_BEFORE = "last_value(CASE WHEN class IN ('H', 'X') THEN class END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _tables(source: str) -> str:
    """CTEs from source (doc_id, body) to drawn (doc_id, rest, grid, markdown)."""
    return f"""l1 AS (SELECT doc_id, {_strip("line")} AS line, i FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i FROM {source})),
l2 AS (SELECT *, {_cells_of("line")} AS cells FROM l1),
l3 AS (SELECT *, CASE WHEN line = '' THEN 'B' WHEN line = '[TABLE]' THEN 'H' WHEN regexp_matches(line, '{_QUESTION}') THEN 'X' WHEN {_HEADER} THEN 'H' WHEN {_DATA} THEN 'D' ELSE 'X' END AS class FROM l2),
l4 AS (SELECT *, class = 'H' OR class IN ('B', 'D') AND coalesce({_BEFORE}, 'X') = 'H' AS inside FROM l3),
rest AS (SELECT doc_id, {_strip("string_agg(line, chr(10) ORDER BY i)")} AS rest FROM l4 WHERE NOT inside GROUP BY 1),
ins AS (SELECT *, sum(CASE WHEN len(cells) >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l4 WHERE inside AND line NOT IN ('', '[TABLE]')),
bare AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS bare, count(*) AS n, list(cells ORDER BY i) FILTER (len(cells) > 0) AS each FROM ins GROUP BY 1),
rws AS (SELECT doc_id, list(c ORDER BY r) AS rows_ FROM (SELECT doc_id, r, flatten(list(cells ORDER BY i)) AS c FROM ins WHERE r > 0 GROUP BY 1, 2) GROUP BY 1),
drawn0 AS (SELECT s.doc_id, body, coalesce(rest, '') AS rest, bare, coalesce(n, 0) AS n, coalesce(rows_, []) AS rows_, coalesce(each, []) AS each FROM {source} s LEFT JOIN rest USING (doc_id) LEFT JOIN bare USING (doc_id) LEFT JOIN rws USING (doc_id)),
drawn1 AS (SELECT *, CASE WHEN len(rows_) >= 2 THEN rows_ ELSE each END AS t, len(rows_) >= 2 OR n >= 2 AS is_table FROM drawn0),
drawn AS (SELECT doc_id, CASE WHEN is_table THEN rest ELSE body END AS rest, CASE WHEN len(rows_) >= 2 THEN array_to_string(list_transform(rows_, lambda r: array_to_string(r, chr(9))), chr(10)) WHEN n >= 2 THEN bare END AS grid,
   CASE WHEN is_table THEN CASE WHEN len(t) >= 2 THEN array_to_string(list_concat(['| ' || array_to_string(t[1], ' | ') || ' |', '| ' || array_to_string(list_transform(t[1], lambda r: '---'), ' | ') || ' |'],
     list_transform(t[2:], lambda r: '| ' || array_to_string(list_transform(range(1, len(t[1]) + 1), lambda k: coalesce(r[k], '')), ' | ') || ' |')), chr(10)) ELSE '' END END AS markdown FROM drawn1)"""


_CELL_LIST = ", ".join(f"'{x}'" for x in CELLS)
_GAP_LIST = ", ".join({"\n": "chr(10)", "\t": "chr(9)"}.get(x, f"'{x}'") for x in GAPS)
GRIDS = f"""grids AS (SELECT doc_id, array_to_string(list_transform({_SPLIT_WORDS}, lambda v: replace([{_CELL_LIST}][(ascii(v) + length(v)) % {len(CELLS)} + 1], '~', v)
  || [{_GAP_LIST}][(ascii(reverse(v)) + 5 * length(v)) % {len(GAPS)} + 1]), '') AS body FROM documents)"""
EXAM_TABLES = f"WITH {GRIDS}, {_tables('grids')} SELECT doc_id, rest, grid, markdown FROM drawn"
_LOOSE_ROWS = f"list_transform(parts[1:5], lambda p, i: marks[i] || chr(9) || p[1] || chr(9) || CASE WHEN {_is_cell('p[2]')} THEN p[2] ELSE '' END)"
CHOICE_GRIDS = f"""{CHOICES}, {_tables("bodies")}
SELECT b7.doc_id, coalesce(chr(9) || names[1] || chr(9) || names[2] || chr(10) || CASE WHEN strategy = 'grid' THEN array_to_string(list_transform(cells, lambda g: g.mark || chr(9) || array_to_string(g.parts, chr(9))), chr(10))
  WHEN strategy = 'multicolumn' AND len(names) >= 2 AND len(list_filter(parts[1:5], lambda p: len(p) > 0)) = 5 THEN array_to_string({_LOOSE_ROWS}, chr(10)) END, d.grid) AS grid,
  CAST(length(d.rest) AS INT) AS rest_length FROM b7 JOIN drawn d ON d.doc_id = b7.doc_id"""

_SHEET_LIST = ", ".join(f"'{x}'" for x in SHEET)
_FOUND = "CAST([] AS STRUCT(number INT, answer INT)[])"


def _read_columns(numbers: str) -> str:
    """A fold over numbers lifted into its state: `next` and `found` are the state's, `v` the number."""
    from_first = f"{numbers}[list_position({numbers}, 41):]"
    items = f"CASE WHEN list_position({numbers}, 41) > 0 THEN list_transform({from_first}, lambda v: {{'next': 0, 'v': v, 'found': {_FOUND}}}) ELSE [] END"
    took = "list_append(s.found, {'number': s.next, 'answer': x.v})"
    step = f"""CASE WHEN s.next <= 80 AND x.v BETWEEN 1 AND 5 THEN {{'next': s.next + 1, 'v': 0, 'found': {took}}} WHEN s.next <= 80 AND x.v > s.next AND x.v <= 80 THEN {{'next': x.v, 'v': 0, 'found': s.found}} ELSE s END"""
    return f"list_reduce({items}, lambda s, x: {step}, {{'next': 41, 'v': 0, 'found': {_FOUND}}}).found"


def _alone(text: str) -> str:
    return rf"list_transform(list_filter(string_split(regexp_replace({text}, '[^\p{{L}}\p{{N}}_]', ' ', 'g'), ' '), lambda v: regexp_full_match(v, '\d{{1,3}}')), lambda v: CAST(v AS INT))"


_PAIRS_IN = r"regexp_extract_all(' ' || replace(section, ' ', '  ') || ' ', '[^0-9]((?:4[1-9]|[1-6]\d|7[0-9]|80)[\s.]+[1-5])[^0-9]', 1)"
KEY_SHEETS = rf"""WITH s0 AS (SELECT doc_id, array_to_string(list_transform({_SPLIT_WORDS}, lambda w: replace([{_SHEET_LIST}][(ascii(w) + 3 * length(w)) % {len(SHEET)} + 1], '~', w)), ' ') AS text FROM documents),
s1 AS (SELECT *, regexp_extract(text, '(?s)2교시\s*A[^\n]*') AS sheet FROM s0),
s2 AS (SELECT *, CASE WHEN sheet = '' THEN text ELSE left(sheet, greatest(length(regexp_extract(sheet, '^2교시\s*A')), 0)) || substr(sheet, length(regexp_extract(sheet, '^2교시\s*A')) + 1) END AS block FROM s1),
s3 AS (SELECT *, regexp_extract(block, '(?s)회계\s*학.*') AS part FROM s2),
s4 AS (SELECT *, CASE WHEN part = '' THEN block ELSE left(part, 5) || regexp_replace(substr(part, 6), '(?s)(한국산업|2교시\s*B).*', '') END AS section FROM s3),
s5 AS (SELECT doc_id, text, list_transform({_PAIRS_IN}, lambda v: {{'number': CAST(left(v, 2) AS INT), 'answer': CAST(right(v, 1) AS INT)}}) AS p, {_alone("section")} AS a, {_alone("replace(text, '회계학', ' ')")} AS b FROM s4),
s6 AS (SELECT doc_id, list_concat(p, {_read_columns("a")}) AS x, {_read_columns("b")} AS y FROM s5),
s7 AS (SELECT doc_id, CASE WHEN len(list_distinct(list_transform(x, lambda v: v.number))) >= 30 THEN x ELSE list_concat(x, y) END AS z FROM s6),
s8 AS (SELECT doc_id, unnest(z) AS e, unnest(range(len(z))) AS i FROM s7)
SELECT doc_id, e.number AS number, max_by(e.answer, i) AS answer FROM s8 WHERE e.number BETWEEN 41 AND 80 GROUP BY 1, 2"""


def _number(k: int) -> str:
    return f"format('{{:,}}', length({_word(k)}) * 1111 + {k})"


def _quote(size: int, reach: int) -> str:
    return f"list_filter([1, 2, 3, 4, 5], lambda i: c[i] <> '' AND contains(left(why, {reach}), left(c[i], {size})))[1]"


_BARE_C = "replace(c[i], ',', '')"
_FINALS = r"list_reverse(list_transform(regexp_extract_all(why, '(?:최종 결과|따라서|=)\s*[:\$]?=?\s*([0-9,\.]+)', 1), lambda v: replace(v, ',', '')))"
_HOLDS = rf"list_filter([1, 2, 3, 4, 5], lambda i: list_contains(list_transform(regexp_extract_all(c[i], '[0-9,\.]+'), lambda u: replace(u, ',', '')), v))[1]"
_CHOICE_KINDS = (_word, _word, lambda k: f"'A ' || {_number(k)} || ', B ' || {_number(k + 1)}", lambda k: f"{_number(k)} || '원'", lambda k: f"{_word(k)} || ' 25'")
_HEADS = ("옳은 것은?", "틀린 것은?", "값은?", "얼마인가?", "추정치에 관한 옳은 것을 고르면")
_TAILS = ("text", _word(4), f"'A = ' || {_number(3)} || '이고 B = ' || {_number(4)}", f"'계산 = ' || {_number(2)} || ' 따라서 ' || {_number(5)} || ' 최종 결과 $=77'", "CASE WHEN doc_id % 2 = 0 THEN '추정치의 유용성' ELSE '25% 적용' END")
_ASKED = " UNION ALL ".join(
    f"SELECT doc_id, {41 + j} AS number, '{41 + j}. {_HEADS[j]}' AS head, [{', '.join(_CHOICE_KINDS[j](k + j) for k in range(1, 6))}] AS c, ' ' || {_TAILS[j]} || chr(10) AS why FROM w0" for j in range(5)
)
WORKED = rf"""WITH w0 AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN len({_SPLIT_WORDS}) > 0 THEN {_SPLIT_WORDS} ELSE ['none'] END AS w FROM documents),
asked AS ({_ASKED}),
found AS (SELECT *, CASE WHEN contains(why, '추정치') AND contains(why, '유용성') OR contains(why, '미래 경제적 효익') AND contains(why, '원가') THEN 5 END AS known, regexp_extract_all(why, '(?s)A\s*=\s*([0-9,]+).*?B\s*=\s*([0-9,]+)', 1)[-1] AS va, regexp_extract_all(why, '(?s)A\s*=\s*([0-9,]+).*?B\s*=\s*([0-9,]+)', 2)[-1] AS vb FROM asked)
SELECT doc_id, CAST(number AS INT) AS number, CAST(coalesce(CASE WHEN contains(head, '옳은 것은?') OR contains(head, '옳은 것을') THEN coalesce(known, {_quote(18, 700)}) END, CASE WHEN contains(head, '옳지 않') OR contains(head, '틀린') THEN {_quote(28, 600)} END,
  list_filter([1, 2, 3, 4, 5], lambda i: contains({_BARE_C}, replace(va, ',', '')) AND contains({_BARE_C}, replace(vb, ',', '')))[1],
  list_filter(list_transform({_FINALS}, lambda v: {_HOLDS}), lambda v: v IS NOT NULL)[1], CASE WHEN contains(why, '25%') AND contains(array_to_string(c, ' '), '25') THEN 1 END) AS INT) AS answer FROM found"""

HANGUL = f"hangul AS (SELECT doc_id, translate(lower(text), '{LATIN}', '{SYLLABLES}') AS t FROM documents)"


def _hangul(words: tuple[str, ...]) -> list[str]:
    return [w.translate(str.maketrans(LATIN, SYLLABLES)) for w in words]


def _terms() -> str:
    """One replacement after the other, each twice, since the syllable before a term may end the term before it."""
    t = "t"
    for w in sorted(_hangul(("tion", "ation", "heit", "lich", "ung", "ment", "the", "or", "nd", "keit", "tionti")), key=len, reverse=True):
        for _ in range(2):
            t = f"regexp_replace({t}, '([가-힣])({w})', '\\1 \\2', 'g')"
    for w in _hangul(("be", "re", "an")):  # 1: the prefix, 2 before 1: Hangul before it, 4: Hangul on both sides
        t = f"replace({t}, '{w}', chr(1))"
        for _ in range(2):
            t = f"regexp_replace({t}, '([가-힣\x01])\x01', '\\1\x02\x01', 'g')"
        for _ in range(2):
            t = f"regexp_replace({t}, '\x02\x01([가-힣\x01\x02\x04])', '\x04\\1', 'g')"
        t = f"replace(replace(replace({t}, chr(4), ' {w} '), chr(2), ''), chr(1), '{w}')"
    return t


TERMS_APART = rf"WITH {HANGUL} SELECT doc_id, regexp_replace({_terms()}, '\s{{2,}}', ' ', 'g') AS text FROM hangul"
# Tokens that stay whole, and particles.
_TOKENS = (
    r"(?i)\d{1,3}(?:,\d{3})+(?:\.\d+)?W", r"W\d{1,3}(?:,\d{3})*(?:\.\d+)?", r"￦\d{1,3}(?:,\d{3})*(?:\.\d+)?", r"\d+(?:\.\d+)?%", r"\d+(?:\.\d+)?㎡", r"\d+(?:\.\d+)?(?:원|천원|백만원|억원)",
    r"20×\d{1,2}년\s*\d{1,2}월\s*\d{1,2}일", r"20×\d{1,2}년", r"20×\d{1,2}", r"20[xX]\d{1,2}", r"\(\s*20×\d{1,2}\s*\)년", r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d{3,}",
)
_PARTICLES = "은 는 이 가 을 를 의 에 에서 으로 로 와 과 도 만 부터 까지 하여 하며 하면 하거나 하는 하였 하기 경우 때 것 등 및 있다 없다 이다 아니다 ( （".split()
_STEPS = [(r"[￦₩]", "W"), (r"20[xX](\d)", r"20×\1"), (r"([.?,:;])([가-힣A-Za-z0-9])", r"\1 \2"), (r"([가-힣0-9])(\()", r"\1 \2"), (r"\)([가-힣A-Za-z0-9])", r") \1"), (r"([가-힣])(W\d|\d)", r"\1 \2")]
_UNIT_OK = "년월일원주회번호층시분세"


def _particles() -> str:
    ctes, t = [HANGUL], "hangul"
    for k, p in enumerate(_TOKENS):
        ctes.append(f"m{k} AS (SELECT *, regexp_extract_all(t, '{p}') AS tok{k}, regexp_replace(t, '{p}', chr({0xE100 + k}), 'g') AS n{k} FROM (SELECT * REPLACE ({'n' + str(k - 1) if k else 't'} AS t) FROM {t}))")
        t = f"m{k}"
    x = f"n{len(_TOKENS) - 1}"
    for p, new in _STEPS:
        x = f"regexp_replace({x}, '{p}', '{new}', 'g')"
    parted = f"regexp_replace({x}, '(\\d)([가-힣])', '\\1' || chr(2) || '\\2', 'g')"
    ctes.append(f"a0 AS (SELECT *, replace(regexp_replace({parted}, chr(2) || '([{_UNIT_OK}])', '\\1', 'g'), chr(2), ' ') AS x FROM {t})")
    short, long_ = ([f"'{w}'" for w in _PARTICLES if len(w) == n] for n in (1, 2))
    starts = f"n1_ IN ({', '.join(short)}) OR n1_ || n2_ IN ({', '.join(long_)}) OR n1_ || n2_ || n3_ = '아니다'"
    ctes.append("c0 AS (SELECT doc_id, unnest(string_split(x, '')) AS v, unnest(range(length(x))) AS i FROM a0 WHERE x <> '')")
    ctes.append("c1 AS (SELECT *, coalesce(lead(v) OVER w, '') AS n1_, coalesce(lead(v, 2) OVER w, '') AS n2_, coalesce(lead(v, 3) OVER w, '') AS n3_ FROM c0 WINDOW w AS (PARTITION BY doc_id ORDER BY i))")
    ctes.append(f"c2 AS (SELECT doc_id, string_agg(v || CASE WHEN v BETWEEN '가' AND '힣' AND ({starts}) THEN ' ' ELSE '' END, '' ORDER BY i) AS y FROM c1 GROUP BY 1)")
    ctes.append("a1 AS (SELECT a0.*, coalesce(y, x) AS y FROM a0 LEFT JOIN c2 USING (doc_id))")
    y = r"regexp_replace(regexp_replace(regexp_replace(y, '\(\s+', '(', 'g'), '\s+\)', ')', 'g'), '[ \t]{2,}', ' ', 'g')"
    for k in range(len(_TOKENS)):
        ctes.append(f"r{k} AS (SELECT * EXCLUDE (y), array_to_string(list_transform(string_split(y, chr({0xE100 + k})), lambda p, i: p || coalesce(tok{k}[i], '')), '') AS y FROM (SELECT * REPLACE ({y if k == 0 else 'y'} AS y) FROM {'a1' if k == 0 else f'r{k - 1}'}))")
    return f"WITH {', '.join(ctes)} SELECT doc_id, y AS text FROM r{len(_TOKENS) - 1}"


PARTICLES_APART = _particles()

_TERM_LIST = ", ".join(f"'{x}'" for x in ACCOUNTING)
SENTENCES = f"""sentences AS (SELECT doc_id, i, array_to_string(list_transform(list_filter(regexp_split_to_array(s, '[ \\n\\t]+'), lambda w: w <> ''), lambda w: coalesce([{_TERM_LIST}][(ascii(w) + 3 * length(w)) % {OTHER_WORDS} + 1], w)), ' ') AS text
FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s, CAST(unnest(range(0, len(string_split(text, '.')))) AS INT) AS i FROM documents))"""


def _any(words: tuple[str, ...], column: str = "text") -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_PATTERN = " ".join(f"WHEN {_any(words)} THEN {{'p': '{p}', 'c': '{c}'}}" for p, c, words in RULES)
_PHASE = f"""CASE WHEN {_any(IN_TRANSIT)} AND NOT contains(left(text, 80), '매출원가') AND NOT contains(text, '선입선출') AND NOT contains(text, '가중평균') THEN 'ACC_INV_001' WHEN contains(text, 'FOB') OR contains(text, 'CIF') THEN 'ACC_INV_002'
 WHEN {_any(FIRST_PHASE[2][1])} THEN 'ACC_INV_003' WHEN {_any(FIRST_PHASE[3][1])} AND NOT {_any(FIRST_PHASE[3][2])} THEN 'ACC_INV_005'
 WHEN {_any(COST_FLOW)} THEN CASE WHEN contains(text, '소매재고') THEN 'ACC_INV_007' WHEN regexp_matches(text, '선입|FIFO|평균|단가') THEN 'ACC_INV_006' ELSE 'ACC_INV_004' END
 WHEN {_any(FIRST_PHASE[7][1])} THEN 'ACC_INV_007' WHEN {_any(FIRST_PHASE[8][1])} THEN 'ACC_INV_008' WHEN contains(text, '재고자산') THEN 'ACC_INV_004' ELSE 'ACC_INV_001' END"""
_KIND_OF = r"CASE WHEN regexp_matches(text, '옳지 않은|틀린|거리가 먼') THEN 'incorrect_statement' WHEN regexp_matches(text, '계산|금액|￦|\d{3,}') THEN 'calculation' WHEN regexp_matches(text, '[ㄱㄴㄷㄹㅁㅂㅅㅇ]') THEN 'mixed' ELSE 'concept' END"
PATTERNS = f"WITH {SENTENCES} SELECT doc_id, i, x.p AS pattern_id, x.c AS chapter_id, first_phase, kind FROM (SELECT doc_id, i, CASE {_PATTERN} ELSE {{'p': '{OTHER[0]}', 'c': '{OTHER[1]}'}} END AS x, {_PHASE} AS first_phase, {_KIND_OF} AS kind FROM sentences)"


def _reason(*names: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN list_contains(o, '{n}') THEN 'r_{n}' END" for n in (*names, "")) + ")"


_RULES_OF = (
    ("regexp_matches(c, 'vat|부가|세금') OR regexp_matches(s, 'vat|부가')", ("vat",)),
    ("regexp_matches(c, '할인|에누리')", ("discount",)),
    ("regexp_matches(s, 'fifo|선입|선출') OR regexp_matches(c, 'fifo|선입')", ("fifo",)),
    ("regexp_matches(s, '평균|가중') OR regexp_matches(c, '평균')", ("avg",)),
    ("regexp_matches(s, 'fob|선적|도착|운송')", ("fob_swap",)),
    ("regexp_matches(s, '위탁|적송')", ("consignment",)),
    ("regexp_matches(s, '시송')", ("trial",)),
    ("regexp_matches(s, 'per|pr|실지|계속')", ("per_pr", "method")),
    ("regexp_matches(s, 'lcm|순실현|nrv|순매')", ("nrv", "no_loss")),
    (r"regexp_matches(c, '\d')", ("calc",)),
    ("true", ("formula", "generic")),
)
_REASONS = ", ".join(f"CASE WHEN {fits} THEN {_reason(*names)} END" for fits, names in _RULES_OF)
WRONG_REASONS = f"""WITH {SENTENCES}, t AS (SELECT doc_id, i, lower(text) AS s, lower(string_split(text, ' ')[-1]) AS c,
 [['vat', 'fifo'], ['avg', 'fob_swap', 'calc'], ['generic'], ['method', 'trial', 'no_loss'], CAST([] AS VARCHAR[])][(doc_id + i) % 5 + 1] AS o FROM sentences)
SELECT doc_id, i, coalesce({_REASONS}, 'r_' || o[(i % 5 + 1 + doc_id % 5 + 1) % greatest(len(o), 1) + 1], '{NO_REASON}') AS reason FROM t"""

_R_TEXT = RESTRUCTURED[RESTRUCTURED.index("WITH ") + 5 : RESTRUCTURED.rindex("SELECT doc_id, trim(")]
_R_LAST = RESTRUCTURED[RESTRUCTURED.rindex("SELECT doc_id, trim(") :]
_LOSSES = (
    ("critical", "empty_paren_year", r"regexp_matches(stem, '\(\s*\)\s*년')"),
    ("critical", "missing_year_pair", r"regexp_matches(stem, '년\s*과\s*년\s*에')"),
    ("critical", "missing_year_pair_genitive", r"regexp_matches(stem, '년\s*과\s*년\s*의')"),
    ("critical", "missing_date_parts", r"regexp_matches(stem, '년\s*월\s*일') AND regexp_matches(regexp_replace(stem, '20[×xX]\d{1,2}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일', '', 'g'), '년\s*월\s*일')"),
    ("critical", "choice_grid_header_in_stem", r"regexp_matches(stem, '\?\s*년\s+20[×xX]\d{1,2}\s+년\s+20[×xX]\d{1,2}')"),
    ("critical", "merged_w_choice", "doc_id % 4 = 0"),
    ("warning", "stem_equals_original_with_table", "doc_id % 2 = 0 AND trim(stem) = trim(original)"),
    ("warning", "possible_duplicate_stem_context", "stem <> '' AND trim(stem) = trim(original) AND length(stem) > 200 AND regexp_matches(original, '[①②③④⑤]')"),
)
LOST = f"""WITH {_R_TEXT.strip()}, fixed AS ({_R_LAST}), stored AS (SELECT doc_id, v0.t AS stem, CASE doc_id % 3 WHEN 0 THEN v0.t WHEN 1 THEN v0.t || ' ①' ELSE fixed.text END AS original FROM v0 JOIN fixed USING (doc_id))
{" UNION ALL ".join(f"SELECT doc_id, '{s}' AS severity, '{c}' AS category FROM stored WHERE {w}" for s, c, w in _LOSSES)}"""


def _units(x: str) -> str:
    every = ", ".join(f"regexp_extract_all({x}, '{p}')" for p in _TOKENS[:-1])
    return f"list_sort(list_distinct(flatten([{every}])))"


_FOOTLESS = f"regexp_replace({_clean('body')}, '^\\d{{1,2}}\\.', '')"
SLICES = rf"""WITH {BODIES},
texts AS (SELECT CAST(doc_id // 40 AS INT) AS year, string_agg(body, chr(12) ORDER BY doc_id, body) AS text FROM bodies GROUP BY 1),
ch AS (SELECT year, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS i FROM texts),
nb AS (SELECT *, coalesce(lag(c) OVER w, '') AS p, coalesce(lead(c) OVER w, '') AS n1, coalesce(lead(c, 2) OVER w, '') AS n2, coalesce(lead(c, 3) OVER w, '') AS n3 FROM ch WINDOW w AS (PARTITION BY year ORDER BY i)),
mk AS (SELECT year, i - 1 AS position, CASE WHEN n1 = '.' THEN CAST(c AS INT) ELSE CAST(c || n1 AS INT) END AS number FROM nb WHERE c BETWEEN '0' AND '9' AND NOT (p BETWEEN '0' AND '9' OR p = '.')
       AND (n1 = '.' AND NOT n2 BETWEEN '0' AND '9' OR n1 BETWEEN '0' AND '9' AND n2 = '.' AND NOT n3 BETWEEN '0' AND '9')),
st AS (SELECT year, min(position) AS start FROM mk WHERE number = 41 GROUP BY 1),
fm AS (SELECT year, number, min(position) AS position FROM mk JOIN st USING (year) WHERE position >= start AND number BETWEEN 41 AND 80 GROUP BY 1, 2),
ld AS (SELECT *, lead(number) OVER w AS n2, lead(position) OVER w AS p2 FROM fm WINDOW w AS (PARTITION BY year ORDER BY number)),
al AS (SELECT year, number, position FROM fm UNION ALL SELECT year, k, position + CAST(trunc((p2 - position) * (k - number)::DOUBLE / (n2 - number)) AS BIGINT) FROM (SELECT *, unnest(range(number + 1, n2)) AS k FROM ld WHERE n2 - number BETWEEN 2 AND 3)),
sp AS (SELECT year, number, position, lead(position) OVER (PARTITION BY year ORDER BY position, number) AS stop FROM al),
bd AS (SELECT year, number, trim(substr(text, position + 1, coalesce(stop, length(text)) - position)) AS body, 1 + len(regexp_extract_all(left(text, position), chr(12))) AS page FROM sp JOIN texts USING (year)),
cl AS (SELECT *, {_FOOTLESS} AS bare FROM bd)
SELECT year, CAST(number AS INT) AS number, CAST(page AS INT) AS page, CAST(length(body) AS INT) AS length, left(sha256(body), 16) AS body_hash, CAST(length(regexp_replace(body, '[^{MARKS}]', '', 'g')) AS INT) AS n_marks,
  array_to_string(list_sort(list_distinct(regexp_extract_all(bare, '{_TOKENS[-1]}'))), ' ') AS numbers, array_to_string({_units("bare")}, ' ') AS units FROM cl"""

_FILES = """files AS (SELECT 'exams/' || (doc_id % 3) || '/' || (1900 + (doc_id * 13) % 150) || ['.pdf', '.hwp', '.json', '-2.pdf', '-ocr-1.txt', '.txt', '-answers.hwp'][doc_id % 7 + 1] AS path FROM documents),
named AS (SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem, regexp_extract(path, '\\.([^.]*)$', 1) AS kind FROM files),
years AS (SELECT DISTINCT CAST(1990 + doc_id % 80 AS INT) AS year FROM documents)"""
EXAM_FILES = rf"""WITH {_FILES} SELECT year, path, kind FROM years LEFT JOIN (SELECT CAST(stem AS INT) AS year, path, kind FROM named WHERE kind IN ('hwp', 'pdf') AND regexp_full_match(stem, '\d{{4}}')
 QUALIFY row_number() OVER (PARTITION BY stem ORDER BY kind = 'pdf', path) = 1) USING (year)"""
ANSWER_FILES = rf"""WITH {_FILES}, keys AS (SELECT CAST(1990 + p_partkey % 70 AS INT) AS year, count(*) AS n FROM part WHERE p_size + 30 BETWEEN 41 AND 80 AND p_partkey % 3 > 0 GROUP BY 1),
j AS (SELECT CAST(stem AS INT) AS year, min(path) AS json_path FROM named WHERE kind = 'json' AND regexp_full_match(stem, '\d{{4}}') GROUP BY 1)
SELECT year, json_path, CASE WHEN json_path IS NOT NULL THEN coalesce(n, 0) ELSE 0 END AS json_count, s.path AS source_path, s.kind AS source_kind FROM years LEFT JOIN j USING (year) LEFT JOIN keys USING (year)
 LEFT JOIN (SELECT y.year AS yr, min({{'path': path, 'kind': kind}}) AS s FROM named JOIN years y ON contains(name, CAST(y.year AS VARCHAR)) WHERE kind IN ('pdf', 'hwp') GROUP BY 1) ON yr = year"""
CACHES = rf"""WITH {_FILES} SELECT year, path FROM years LEFT JOIN (SELECT CAST(left(stem, 4) AS INT) AS year, min(path) AS path FROM named WHERE kind = 'txt' AND regexp_matches(stem, '^\d{{4}}-') GROUP BY 1) USING (year)"""

HEADED = """headed AS (SELECT doc_id, replace(text, '.', CASE doc_id % 3 WHEN 0 THEN ' ' || (2000 + doc_id % 30) || '년 제' || (doc_id % 40) || '회 ' WHEN 1 THEN (1990 + doc_id % 40) || '년도 감정평가사' ELSE ' 회계학 41. ' END) AS text FROM documents)"""
_HEAD = r"\d{4}년\s*(?:제\d+회|도\s*감정평가사)"
YEAR_SECTIONS = rf"""WITH {HEADED}, f AS (SELECT doc_id, regexp_extract_all(text, '{_HEAD}') AS h, regexp_split_to_array(text, '{_HEAD}') AS g FROM headed),
u AS (SELECT doc_id, unnest(h) AS h, unnest(g[1:len(h)]) AS g, unnest(range(len(h))) AS i FROM f)
SELECT doc_id, CAST(i AS INT) AS i, CAST(left(h, 4) AS INT) AS year, try_cast(regexp_extract(h, '제(\d+)회', 1) AS INT) AS round,
  CAST(sum(length(g)) OVER w + coalesce(sum(length(h)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS position FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""
SUBJECT_STARTS = rf"""WITH {HEADED} SELECT doc_id, CAST(CASE WHEN contains(text, '회계학') THEN strpos(text, '회계학') - 1 WHEN regexp_matches(text, '(^|[^\d.])41\.([^\d]|$)') THEN length(regexp_extract(text, '^((?s:.*?)(?:^|[^\d.]))41\.(?:[^\d]|$)', 1)) ELSE 0 END AS INT) AS start,
 CAST(coalesce(nullif(regexp_extract(text, '(\d{{4}})년도\s*감정평가사', 1), ''), nullif(regexp_extract(text, '(\d{{4}})년\s*제\d+회', 1), '')) AS INT) AS year, CAST(CASE WHEN contains(text, '회계학') THEN length(text) - strpos(text, '회계학') + 1 END AS INT) AS rest FROM headed"""
_PAIRED = r"regexp_extract_all(choice, '20[×xX]\d{1,2}년\s+W[\d,]+(?:\.\d+)?')"
YEAR_AMOUNTS = CHOICES + f""", cs AS (SELECT doc_id, unnest(cc) AS choice, unnest(range(1, len(cc) + 1)) AS i FROM (SELECT doc_id, {_WHOLE} AS cc FROM b7))
SELECT doc_id, coalesce(['①', '②', '③', '④', '⑤'][i], CAST(i AS VARCHAR)) AS label, CASE WHEN len({_PAIRED}) >= 2 THEN array_to_string({_PAIRED}, '|') END AS pairs FROM cs"""
TUTOR = """WITH own AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 7 END AS t, CASE WHEN s_suppkey % 5 = 0 THEN s_name END AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'why ' || s_name END AS why, CASE WHEN s_suppkey % 3 = 2 THEN s_name END AS steps, CASE WHEN s_suppkey % 6 = 0 THEN 'tip' END AS tip FROM supplier),
prof AS (SELECT n_nationkey AS p, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 5 END AS t, CASE WHEN n_nationkey % 7 > 0 THEN n_name END AS why, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS steps, CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS tip FROM nation WHERE n_nationkey <> 24),
j AS (SELECT p_partkey, p_partkey % 25 AS pat, own.*, prof.n_name, prof.t AS pt, prof.why AS pwhy, prof.steps AS psteps, coalesce(prof.tip, '핵심 원칙을 떠올린다') AS ptip FROM part LEFT JOIN own ON id = p_partkey LEFT JOIN prof ON p = p_partkey % 25)
SELECT p_partkey AS question_id, coalesce(title, n_name, CAST(pat AS VARCHAR)) AS title, coalesce(why, pwhy, '풀이 준비 중') AS explanation,
 coalesce(steps, concat_ws('|', CASE WHEN r_name IS NOT NULL THEN '[' || r_name || '] a = b|one|' || r_name END, psteps)) AS steps,
 coalesce(tip, CASE WHEN r_regionkey % 2 = 0 THEN ptip || E'\n\n[계산 템플릿] ' || r_name ELSE ptip END) AS tip, id IS NOT NULL AS has_override
FROM j LEFT JOIN region ON r_regionkey = coalesce(t, pt)"""
GATES = """SELECT gate, hits, total, round(hits::DOUBLE / greatest(total, 1), 6) AS rate, least, hits::DOUBLE / greatest(total, 1) >= least AS passed FROM (WITH r AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'labelled' AS gate, count(*) FILTER (quality IS NOT NULL) AS hits, count(*) AS total, 0.3::DOUBLE AS least FROM r UNION ALL SELECT 'good', count(*) FILTER (quality = 1), count(quality), 0.9::DOUBLE FROM r
UNION ALL SELECT 'clean_english', count(*) FILTER (toxic = 0 AND lang = 'en'), count(*) FILTER (toxic IS NOT NULL AND lang = 'en'), 0.5::DOUBLE FROM r UNION ALL SELECT 'none', 0, 0, 0.1::DOUBLE)"""

_BODY_PATTERN = " ".join(f"WHEN {_any(words, 'b7.body')} THEN {{'p': '{p}', 'c': '{c}'}}" for p, c, words in RULES)
EXAM_RECORDS = f"""{CHOICES}, {_tables("bodies")}, gr AS ({CHOICE_GRIDS[len(CHOICES) + 2 + len(_tables("bodies")) :]}),
nc AS (SELECT doc_id, len({_WHOLE}) AS n FROM b7)
SELECT b7.doc_id, format('ACC_{{}}_Q{{:03d}}', b7.doc_id // 40, b7.doc_id % 40 + 41) AS question_id, CAST(b7.doc_id % 40 + 41 AS INT) AS number, x.p AS pattern_id, x.c AS chapter_id, CAST(nullif(nc.n, 0) AS INT) AS answer, coalesce(strategy, 'none') AS question_type,
  gr.grid IS NOT NULL AS has_table, contains(b7.body, 'W') AS has_calculation, coalesce(CASE WHEN gr.grid IS NOT DISTINCT FROM drawn.grid THEN nullif(drawn.markdown, '') END, gr.grid) AS table_text, CAST(length(drawn.rest) AS INT) AS original_length, 'original_exam' AS source_type
FROM (SELECT *, CASE {_BODY_PATTERN} ELSE {{'p': '{OTHER[0]}', 'c': '{OTHER[1]}'}} END AS x FROM b7) b7 JOIN drawn USING (doc_id) JOIN gr USING (doc_id) JOIN nc USING (doc_id)"""

ORACLE_SQL = {
    "rejoined_lines": REJOINED,
    "restructured_lines": RESTRUCTURED,
    "exam_choices": EXAM_CHOICES,
    "exam_tables": EXAM_TABLES,
    "choice_grids": CHOICE_GRIDS,
    "key_sheets": KEY_SHEETS,
    "worked_answers": WORKED,
    "terms_apart": TERMS_APART,
    "particles_apart": PARTICLES_APART,
    "accounting_patterns": PATTERNS,
    "wrong_reasons": WRONG_REASONS,
    "lost_on_the_way": LOST,
    "source_slices": SLICES,
    "exam_file_sources": EXAM_FILES,
    "answer_file_sources": ANSWER_FILES,
    "cached_texts": CACHES,
    "year_sections": YEAR_SECTIONS,
    "subject_starts": SUBJECT_STARTS,
    "year_amounts": YEAR_AMOUNTS,
    "tutor_sections": TUTOR,
    "quality_gates": GATES,
    "exam_records": EXAM_RECORDS,
}
