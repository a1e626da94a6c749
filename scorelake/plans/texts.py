"""Answers in words: response filters, normalisers, text scores, multiple choice, prompts and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import answers, prompts, strings, textscores, windows
from scorelake.operators import pipelines, results
from scorelake.plans.carriers import BOXES, CHOICES, PLAN_LABEL, PLAN_TASK
from scorelake.plans.catalogue import derived, plain, query, r6, rounded, table

WS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)"


# ---- response filters ----

@query("regex_answers", r"""
SELECT doc_id, coalesce(trim(regexp_extract_all(text, '(\d+)', 1)[1], """ + WS + r"""), '[invalid]') AS first_number,
  coalesce(trim(regexp_extract_all(text, '(\d+)', 1)[-1], """ + WS + r"""), '[invalid]') AS last_number,
  coalesce(nullif(regexp_extract_all(text, '([A-Z][a-z]+)!!|([a-z]+)###', 1)[1], ''), nullif(regexp_extract_all(text, '([A-Z][a-z]+)!!|([a-z]+)###', 2)[1], ''), '[none]') AS marked
FROM documents""")
def regex_answers(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents", heavy=True).select(
        "doc_id", answers.regex_text(text, r"(\d+)").alias("first_number"),
        answers.regex_text(text, r"(\d+)", group_select=-1).alias("last_number"),
        answers.regex_text(text, r"([A-Z][a-z]+)!!|([a-z]+)###", fallback="[none]").alias("marked"),
    )


RESPONSES = """
SELECT o_orderkey AS doc_id, o_custkey AS c, o_orderstatus AS a, o_orderpriority AS b FROM {orders}
"""
RESPONSE_LIST = "[' ' || a, b, CASE WHEN c % 3 = 0 THEN ' ' || a ELSE b || '?' END, CASE WHEN c % 5 = 0 THEN b ELSE '  x' END]"


def response_rows(spark, sf_dir):
    c = F.col("c")
    lead = F.concat(F.lit(" "), F.col("a"))
    return derived(spark, sf_dir, RESPONSES).withColumn("resps", F.array(
        lead, F.col("b"), F.when(c % 3 == 0, lead).otherwise(F.concat("b", F.lit("?"))),
        F.when(c % 5 == 0, F.col("b")).otherwise(F.lit("  x")),
    ))


@query("named_response_filters", f"""
WITH r AS (SELECT doc_id, {RESPONSE_LIST} AS l FROM ({plain(RESPONSES)}))
SELECT doc_id, l[1] AS "none", lower(l[1]) AS lower_first, array_to_string(l[1:2], '|') AS first_two,
  list_reduce(list_transform(range(1, 5), lambda i: struct_pack(n := len(list_filter(l, lambda x: x = l[i])), at := -i, t := l[i])),
              lambda x, y: CASE WHEN y.n > x.n THEN y ELSE x END).t AS voted,
  regexp_replace(l[4], '^ ', '') AS one_blank_less,
  CASE l[1] WHEN ' O' THEN 'open' WHEN ' F' THEN 'filled' ELSE 'other' END AS mapped
FROM r""")
def named_response_filters(spark, sf_dir):
    out = pipelines.apply_pipelines(response_rows(spark, sf_dir), {
        "none": [("take_first", {})],
        "lower_first": [("lowercase", {}), ("take_first", {})],
        "two": [("take_first_k", {"k": 2})],
        "vote": [("majority_vote", {}), ("take_first", {})],
        "blank": [("remove_whitespace", {})],
        "mapped": [("map", {"mapping_dict": {" O": "open", " F": "filled"}, "default_value": "other"}), ("take_first", {})],
    })
    return out.select(
        "doc_id", "none", "lower_first", F.array_join("two", "|").alias("first_two"), F.col("vote").alias("voted"),
        F.get("blank", F.lit(3)).alias("one_blank_less"), "mapped",
    )


@query("majority_vote_over_rows", """
WITH v AS (SELECT o_custkey, o_orderpriority AS resp, count(*) AS n, min(o_orderkey) AS first_at FROM orders GROUP BY 1, 2)
SELECT o_custkey, first(resp ORDER BY n DESC, first_at) AS vote FROM v GROUP BY 1""")
def majority_vote_over_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderpriority").alias("resp"), F.col("o_orderkey").alias("idx")
    )
    return pipelines.majority_by_rows(rows, ["o_custkey"])


CHOICE_RESPONSE = """CASE WHEN doc_id % 5 = 0 THEN 'the answer is (B).' WHEN doc_id % 5 = 1 THEN 'I think ' || upper(c0) || '!'
  WHEN doc_id % 5 = 2 THEN 'answer: C' WHEN doc_id % 5 = 3 THEN 'both ' || c3 || ' or ' || c1 ELSE 'no idea' END"""



@query("multi_choice_answers", f"""
WITH c AS (SELECT *, {CHOICE_RESPONSE} AS resp, [lower(c0), lower(c1), lower(c2), lower(c3)] AS o FROM ({plain(CHOICES)})),
m AS (SELECT *, regexp_extract_all(resp, '(\\([A-Z]\\))', 1)[1] AS main,
  (SELECT arg_min(struct_pack(t := w, i := i), strpos(lower(resp), w) * 10 + i) FROM (SELECT unnest(o) AS w, generate_subscripts(o, 1) AS i) WHERE strpos(lower(resp), w) > 0) AS hit,
  regexp_extract_all(resp, ':\\s*(A|B|C|D)', 1)[1] AS letter FROM c)
SELECT doc_id, coalesce(main, '(' || chr(CAST(64 + len(o) + 1 - list_position(list_reverse(o), hit.t) AS INT)) || ')', '(' || letter || ')', '[invalid]') AS answer FROM m""")
def multi_choice_answers(spark, sf_dir):
    rows = derived(spark, sf_dir, CHOICES).withColumn("resp", F.expr(CHOICE_RESPONSE)).withColumn(
        "choices", F.array("c0", "c1", "c2", "c3")
    )
    answer = answers.multi_choice_text(F.col("resp"), F.col("choices"), r"(\([A-Z]\))", ignore_case=True)
    return rows.select("doc_id", answer.alias("answer"))


QUESTION = "'Which one?' || chr(10) || 'A. ' || c0 || chr(10) || 'B. ' || c2 || chr(10) || 'C. ' || c1"


@query("simple_choice_answers", f"""
WITH c AS (SELECT *, 'It is, ' || CASE WHEN doc_id % 3 = 0 THEN c0 WHEN doc_id % 3 = 1 THEN c2 ELSE 'hard to say' END || '.' AS resp FROM ({plain(CHOICES)})),
d AS (SELECT doc_id, trim(regexp_replace(resp, '[^\\w\\s]', '', 'g')) AS clean, c0, c1, c2 FROM c)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'A' WHEN doc_id % 3 = 1 THEN 'B' ELSE clean END AS answer FROM d""")
def simple_choice_answers(spark, sf_dir):
    rows = derived(spark, sf_dir, CHOICES)
    question = F.concat(F.lit("Which one?\nA. "), "c0", F.lit("\nB. "), "c2", F.lit("\nC. "), "c1")
    said = F.when(F.col("doc_id") % 3 == 0, F.col("c0")).when(F.col("doc_id") % 3 == 1, F.col("c2")).otherwise(F.lit("hard to say"))
    text = F.concat(F.lit("It is, "), said, F.lit("."))
    return rows.select("doc_id", answers.simple_choice_text(text, question).alias("answer"))


@query("reasoning_answers", """
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'so <answer> ' || text || chr(10) || '</answer> done'
  WHEN turn % 3 = 1 THEN 'thus \\boxed{ ' || role || ' } is it' ELSE text END AS s FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN regexp_matches(s, '(?s)<answer>\\s*(.*?)\\s*</answer>') THEN regexp_extract(s, '(?s)<answer>\\s*(.*?)\\s*</answer>', 1)
  WHEN regexp_matches(s, '(?s)\\\\boxed\\{\\s*(.*?)\\s*\\}') THEN regexp_extract(s, '(?s)\\\\boxed\\{\\s*(.*?)\\s*\\}', 1) ELSE s END) AS answer_md5 FROM t""")
def reasoning_answers(spark, sf_dir):
    turn = F.col("turn")
    said = (
        F.when(turn % 3 == 0, F.concat(F.lit("so <answer> "), "text", F.lit("\n</answer> done")))
        .when(turn % 3 == 1, F.concat(F.lit("thus \\boxed{ "), "role", F.lit(" } is it"))).otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(answers.reasoning_answer_text(said)).alias("answer_md5")
    )


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _vqa_oracle() -> str:
    text = f"trim(replace(replace(replace(lower(text), ',', ''), '?', ''), '''s', ' ''s'), {WS})"
    base = f"trim(translate({text}, chr(10)||chr(9), '  '), {WS})"
    ctes = [f"s0 AS (SELECT doc_id, {base} AS w0, regexp_matches({base}, '\\d,+\\d') AS grouped FROM documents)",
            "t0 AS (SELECT doc_id, w0, grouped, w0 AS w1 FROM s0)"]
    for i, mark in enumerate(answers.PUNCTUATION):
        ctes.append(
            f"t{i + 1} AS (SELECT doc_id, w0, grouped, CASE WHEN contains(w0, {_q(mark + ' ')}) OR contains(w0, {_q(' ' + mark)}) OR grouped "
            f"THEN replace(w1, {_q(mark)}, '') ELSE replace(w1, {_q(mark)}, ' ') END AS w1 FROM t{i})"
        )
    last = f"t{len(answers.PUNCTUATION)}"
    # a period goes unless a digit follows, the first 32 of them only
    ctes.append(f"u AS (SELECT doc_id, string_split(regexp_replace(w1, '\\.(\\d)', chr(1) || '\\1', 'g'), '.') AS parts FROM {last})")
    ctes.append("v AS (SELECT doc_id, replace(array_to_string(parts[:33], '') || CASE WHEN len(parts) > 33 THEN '.' || array_to_string(parts[34:], '.') ELSE '' END, chr(1), '.') AS w FROM u)")
    numbers = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in answers.NUMBER_WORDS.items()) + "}"
    contractions = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in answers.CONTRACTIONS.items()) + "}"
    ctes.append(f"x AS (SELECT doc_id, list_filter(list_transform(list_filter(regexp_split_to_array(lower(w), '\\s+'), lambda a: a <> ''), lambda a: coalesce({numbers}[a], a)), lambda a: a NOT IN ('a', 'an', 'the')) AS l FROM v)")
    return "WITH " + ", ".join(ctes) + f" SELECT doc_id, md5(array_to_string(list_transform(l, lambda a: coalesce({contractions}[a], a)), ' ')) AS answer_md5 FROM x"


@query("vqa_answers", _vqa_oracle())
def vqa_answers(spark, sf_dir):
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.md5(answers.vqa_answer_text(F.col("text"))).alias("answer_md5"))


# ---- text scores ----

PAIRED = """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, n_name AS nation
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
"""


@query("exact_match_scores", f"""
WITH p AS ({plain(PAIRED)}), q AS (SELECT id, name, segment, lower(segment) || '!' AS loud, name || '7' AS more FROM p)
SELECT count(*) AS n, round(avg(CAST(loud = segment AS INT)), 6) AS as_is,
  round(avg(CAST(translate(lower(loud), '!', '') = lower(segment) AS INT)), 6) AS case_and_punctuation,
  round(avg(CAST(regexp_replace(more, '[0-9#]', '', 'g') = regexp_replace(name, '[0-9#]', '', 'g') AS INT)), 6) AS numbers,
  round(avg(CAST(regexp_replace(loud, 'i.*$', '') = regexp_replace(lower(segment), 'i.*$', '') AS INT)), 6) AS pattern
FROM q""")
def exact_match_scores(spark, sf_dir):
    rows = derived(spark, sf_dir, PAIRED)
    loud, more = F.concat(F.lower("segment"), F.lit("!")), F.concat("name", F.lit("7"))
    match = textscores.exact_match
    return rounded(rows.agg(
        F.count("*").alias("n"), F.avg(match(loud, F.col("segment"))).alias("as_is"),
        F.avg(match(loud, F.col("segment"), ignore_case=True, ignore_punctuation=True)).alias("case_and_punctuation"),
        F.avg(match(more, F.col("name"), ignore_numbers=True, ignore_punctuation=True)).alias("numbers"),
        F.avg(match(loud, F.lower("segment"), regexes_to_ignore=["i.*$"])).alias("pattern"),
    ))


@query("edit_distance_scores", f"""
WITH p AS ({plain(PAIRED)}), q AS (SELECT id, segment || ' ' || nation AS pred, [lower(segment) || '  ' || nation, segment, nation] AS refs FROM p),
d AS (SELECT id, list_min(list_transform(refs, lambda r: CAST(levenshtein(regexp_replace(trim(lower(r)), '\\s+', ' ', 'g'), regexp_replace(trim(lower(pred)), '\\s+', ' ', 'g')) AS DOUBLE) / greatest(len(upper(r)), len(upper(pred))))) AS low,
  levenshtein(refs[2], pred) AS edits FROM q)
SELECT id, CAST(edits AS INT) AS edits, round(CASE WHEN 1 - low >= 0.5 THEN 1 - low ELSE 0 END, 6) AS anls FROM d""")
def edit_distance_scores(spark, sf_dir):
    rows = derived(spark, sf_dir, PAIRED)
    pred = F.concat("segment", F.lit(" "), "nation")
    refs = F.array(F.concat(F.lower("segment"), F.lit("  "), "nation"), F.col("segment"), F.col("nation"))
    return rounded(rows.select(
        "id", F.levenshtein(F.col("segment"), pred).cast("int").alias("edits"), textscores.anls(refs, pred).alias("anls")
    ))


@query("several_accepted_answers", f"""
WITH p AS ({plain(PAIRED)})
SELECT segment, round(avg(CASE WHEN trim('  ' || segment || ' ') IN (segment, nation, 'x') THEN 1.0 ELSE 0.0 END), 6) AS any_match,
  round(avg(greatest(CAST(nation = segment AS INT), CAST(upper(segment) = segment AS INT))), 6) AS best
FROM p GROUP BY segment""")
def several_accepted_answers(spark, sf_dir):
    rows = derived(spark, sf_dir, PAIRED)
    given = textscores.stripped_responses(F.array(F.concat(F.lit("  "), "segment", F.lit(" "))))
    golds = F.array(F.col("segment"), F.col("nation"), F.lit("x"))
    hit = textscores.any_match(golds, lambda g: textscores.exact_match(F.get(given, F.lit(0)), g))
    best = textscores.best_over(F.array("nation", F.upper("segment")), lambda g: textscores.exact_match(F.col("segment"), g))
    return rounded(rows.groupBy("segment").agg(F.avg(hit).alias("any_match"), F.avg(best).alias("best")))


CHOICE_SQL = f"""
c AS (SELECT *, [c0, c1, c2, c3] AS o, [l0, l1, l2, l3] AS l, [u0, u1, u2, u3] AS u, [l0 < 3, l1 < 3, l2 < 3, l3 < 3] AS greedy FROM ({plain(CHOICES)})),
n AS (SELECT *, list_transform(range(1, 5), lambda i: l[i] / len(o[i])) AS ln, list_transform(range(1, 5), lambda i: l[i] - u[i]) AS g,
  CASE WHEN gold < 4 THEN gold ELSE -100 END AS gi FROM c),
s AS (SELECT doc_id, task, gi AS gold, list_position(l, list_min(l)) - 1 AS pred, list_position(ln, list_min(ln)) - 1 AS pred_norm,
  list_position(g, list_max(g)) - 1 AS pred_gain, CASE WHEN gi >= 0 THEN CAST(greedy[gi + 1] AS INT) ELSE 0 END AS exact_match FROM n)
"""


def choice_rows(spark, sf_dir):
    rows = derived(spark, sf_dir, CHOICES)
    losses = F.array("l0", "l1", "l2", "l3")
    choices = F.array("c0", "c1", "c2", "c3")
    greedy = F.transform(losses, lambda l: l < 3)
    gold = textscores.gold_index(F.col("gold"), choices)
    scored = rows.withColumn("gold_at", gold).withColumn(
        "s", textscores.choice_scores(losses, choices, F.col("gold_at"), greedy, F.array("u0", "u1", "u2", "u3"))
    )
    return scored.select("doc_id", "task", "s.*")


@query("multiple_choice_scores", f"""
WITH {CHOICE_SQL}
SELECT doc_id, CAST(gold AS BIGINT) AS gold, CAST(pred AS BIGINT) AS pred, CAST(pred_norm AS BIGINT) AS pred_norm,
  CAST(pred = gold AS INT)::DOUBLE AS acc, CAST(pred_norm = gold AS INT)::DOUBLE AS acc_norm,
  exact_match, CAST(pred_gain = gold AS INT)::DOUBLE AS acc_mutual_info FROM s""")
def multiple_choice_scores(spark, sf_dir):
    return choice_rows(spark, sf_dir).select(
        "doc_id", F.col("gold").cast("bigint").alias("gold"), F.col("pred").cast("bigint").alias("pred"),
        F.col("pred_norm").cast("bigint").alias("pred_norm"), "acc", "acc_norm", "exact_match", "acc_mutual_info",
    )


@query("several_right_choices", f"""
WITH {CHOICE_SQL}, m AS (SELECT s.*, list_filter([n.gold % 4, (n.gold + 3) % 6], lambda x: x < 4) AS golds, n.greedy FROM s JOIN n USING (doc_id))
SELECT doc_id, CAST(list_contains(golds, pred) AS INT)::DOUBLE AS acc, CAST(list_contains(golds, pred_norm) AS INT)::DOUBLE AS acc_norm,
  CAST(len(list_filter(golds, lambda x: greedy[x + 1])) > 0 AS INT) AS exact_match FROM m""")
def several_right_choices(spark, sf_dir):
    rows = derived(spark, sf_dir, CHOICES)
    losses, choices = F.array("l0", "l1", "l2", "l3"), F.array("c0", "c1", "c2", "c3")
    golds = F.array(F.col("gold") % 4, (F.col("gold") + 3) % 6)
    scores = textscores.multi_gold_scores(losses, choices, golds, F.transform(losses, lambda l: l < 3))
    return rows.select("doc_id", scores.alias("s")).select("doc_id", "s.*")


@query("likelihood_rows", """
SELECT event_id, -value AS perplexity, CAST(user_id % 2 = 0 AS INT) AS acc FROM events""")
def likelihood_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    s = textscores.likelihood_scores(-F.col("value"), F.col("user_id") % 2 == 0)
    return rows.select("event_id", s.alias("s")).select("event_id", "s.*")


@query("token_throughput", """
SELECT lang, round(sum(len(string_split(text, ' ')) * 1.5::DOUBLE), 6) AS tokens, round(CASE WHEN sum(doc_id % 7) > 0 THEN sum(len(string_split(text, ' ')) * 1.5) / sum(doc_id % 7) ELSE 0 END, 6) AS throughput
FROM documents GROUP BY lang""")
def token_throughput(spark, sf_dir):
    totals = table(spark, sf_dir, "documents", heavy=True).groupBy("lang").agg(
        F.sum(strings.estimated_tokens(F.col("text"))).alias("tokens"), F.sum(F.col("doc_id") % 7).alias("seconds")
    )
    return rounded(totals.select("lang", "tokens", strings.throughput(F.col("tokens"), F.col("seconds")).alias("throughput")))


# ---- prompts ----

@query("box_prompts_and_messages", f"""
WITH boxes AS ({plain(BOXES).replace('STRING', 'VARCHAR')}), l AS ({plain(PLAN_LABEL).replace('STRING', 'VARCHAR')}), k AS ({plain(PLAN_TASK).replace('STRING', 'VARCHAR')}),
j AS (SELECT doc_id, target, 'Task:' || chr(10) || 'Given the input medical image: ' || image_description || ', return the coordinates of the lower-left and upper-right corner of the bounding box for the '
  || label_name || '.' || chr(10) || 'Format requirement:' || chr(10) || {_q(prompts.ANSWER_BOX_TRAINING)} AS prompt,
  CAST(string_split(translate(target, '[] ', ''), ',') AS DOUBLE[]) AS t
  FROM boxes JOIN l USING (dataset, task_id, label) JOIN k USING (dataset, task_id))
SELECT doc_id, md5(prompt) AS prompt_md5, printf('%.3f, %.3f, %.3f, %.3f', t[1], t[2], t[3], t[4]) AS answer, 'user,assistant' AS roles, 'image,text' AS parts FROM j""")
def box_prompts_and_messages(spark, sf_dir):
    from scorelake.functions.numbers import parse_fixed_target

    rows = derived(spark, sf_dir, BOXES, heavy=True).join(derived(spark, sf_dir, PLAN_LABEL), ["dataset", "task_id", "label"]).join(
        derived(spark, sf_dir, PLAN_TASK), ["dataset", "task_id"]
    )
    prompt = prompts.box_prompt(F.col("image_description"), F.col("label_name"), prompts.ANSWER_BOX_TRAINING)
    made = rows.withColumn("t", parse_fixed_target(F.col("target"), 4)).withColumn(
        "messages", prompts.chat_messages(prompt, prompts.numbers_answer(F.col("t"), 4))
    )
    content = F.col("messages")[0]["content"]
    return made.select(
        "doc_id", F.md5(content[1]["text"]).alias("prompt_md5"), F.col("messages")[1]["content"][0]["text"].alias("answer"),
        F.array_join(F.col("messages")["role"], ",").alias("roles"), F.array_join(content["type"], ",").alias("parts"),
    )


@query("lesion_and_mask_prompts", f"""
WITH p AS (SELECT p_partkey, p_name, p_type, CASE WHEN p_partkey % 2 = 0 THEN 'millimeters' ELSE 'centimeters' END AS unit, printf('%.3f', 0.25 + p_size / 8::DOUBLE) AS w, printf('%.3f', 0.5 + p_size / 4::DOUBLE) AS h FROM part)
SELECT p_partkey, md5('Task:' || chr(10) || 'Given the input medical image: ' || p_type || ', estimate the major and minor axis lengths of the ellipse enclosing the ' || p_name || ', in ' || unit || '.' || chr(10)
  || 'Additional information:' || chr(10) || 'The pixel size for this image is ' || w || ' ' || unit || ' (width) x ' || h || ' ' || unit || ' (height).' || chr(10) || 'Format requirement:' || chr(10) || {_q(prompts.ANSWER_LESION)}) AS lesion_md5,
  md5('Task:' || chr(10) || 'Given the input medical image: ' || p_type || ', estimate the physical size of the ' || p_name || '.' || chr(10)
  || 'Additional information:' || chr(10) || 'The pixel size for this image is ' || w || ' (width) x ' || h || ' (height).' || chr(10) || 'Format requirement:' || chr(10) || {_q(prompts.ANSWER_MASK)}) AS mask_md5 FROM p""")
def lesion_and_mask_prompts(spark, sf_dir):
    size = F.col("p_size")
    spacing = F.array(0.5 + size / F.lit(4.0), 0.25 + size / F.lit(8.0))
    unit = prompts.unit_name(F.when(F.col("p_partkey") % 2 == 0, F.lit("mm")).otherwise(F.lit("cm")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.md5(prompts.lesion_prompt(F.col("p_type"), F.col("p_name"), unit, spacing)).alias("lesion_md5"),
        F.md5(prompts.mask_prompt(F.col("p_type"), F.col("p_name"), spacing)).alias("mask_md5"),
    )


@query("pixel_spacing_after_resize", """
WITH v AS (SELECT p_partkey, p_partkey % 3 AS d, 64 + p_size AS h, 96 + p_size AS w,
  [0.5 + p_size / 100.0::DOUBLE, 0.7::DOUBLE, 1.0 + p_size / 50.0::DOUBLE] AS z,
  CASE p_partkey % 4 WHEN 0 THEN 896 WHEN 1 THEN 448 WHEN 2 THEN 336 ELSE 560 END AS side FROM part),
s AS (SELECT *, CASE d WHEN 0 THEN [z[2], z[3]] WHEN 1 THEN [z[1], z[3]] ELSE [z[1], z[2]] END AS sp FROM v)
SELECT p_partkey, side, round(sp[1] / (side / h), 6) AS height_spacing, round(sp[2] / (side / w), 6) AS width_spacing,
  'The pixel size for this image is ' || printf('%.3f', sp[2] / (side / w)) || ' millimeters (width) x ' || printf('%.3f', sp[1] / (side / h)) || ' millimeters (height).' AS shown
FROM s""")
def pixel_spacing_after_resize(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_partkey") % 3).alias("d"), F.array(64 + size, 96 + size).alias("image"),
        F.array(0.5 + size / F.lit(100.0), F.lit(0.7), 1.0 + size / F.lit(50.0)).alias("voxel"),
        F.element_at(F.array(*[F.lit(m) for m in ("medgemma", "meddr", "llava_med", "lingshu")]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("model"),
    )
    resized = prompts.model_input_shape(F.col("model"), F.array(F.lit(560), F.lit(560)))
    spaced = rows.withColumn("resized", resized).withColumn(
        "spacing", prompts.resized_spacing(prompts.pixel_spacing(F.col("d"), F.col("voxel")), F.col("image"), F.col("resized"))
    )
    return spaced.select(
        "p_partkey", F.get("resized", F.lit(0)).alias("side"), r6(F.get("spacing", F.lit(0))).alias("height_spacing"),
        r6(F.get("spacing", F.lit(1))).alias("width_spacing"),
        prompts.spacing_text(F.col("spacing"), prompts.unit_name(F.lit("mm"))).alias("shown"),
    )


@query("grey_levels", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT vec_id, CASE WHEN list_max(v) > list_min(v) THEN list_transform(v, lambda x: CAST(floor((x - list_min(v)) / (list_max(v) - list_min(v)) * 255) AS INT)) ELSE list_transform(v, lambda x: 0) END AS q FROM e)
SELECT vec_id, array_to_string(q, ',') AS levels FROM g""")
def grey_levels(spark, sf_dir):
    levels = prompts.to_grey_levels(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(levels.cast("array<string>"), ",").alias("levels"))


# ---- hashes, names, small conversions ----

@query("hashes_and_names", r"""
SELECT page_id, sha256(html) AS hash, octet_length(encode(html)) AS bytes, regexp_replace(array_to_string(string_split(url, '/')[-2:], '/'), '["<>:/\|\\?\*\[\]]+', '__', 'g') AS short_name,
  regexp_replace(url, '["<>:/\|\\?\*\[\]]+', '__', 'g') AS full_name,
  regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g') AS task_name FROM pages""")
def hashes_and_names(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", strings.sha256_text(F.col("html")).alias("hash"), strings.utf8_length(F.col("html")).cast("bigint").alias("bytes"),
        strings.sanitize_model_name(url).alias("short_name"), strings.sanitize_model_name(url, full_path=True).alias("full_name"),
        strings.sanitize_task_name(url).alias("task_name"),
    )


@query("json_checks", """
SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN props || '}' ELSE props END) AS is_json,
  CASE WHEN user_id % 2 = 0 THEN true ELSE false END AS flag FROM events""")
def json_checks(spark, sf_dir):
    broken = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    word = F.when(F.col("user_id") % 2 == 0, F.lit("Yes")).otherwise(F.lit("F"))
    return table(spark, sf_dir, "events").select("event_id", strings.is_json(broken).alias("is_json"), strings.to_boolean(word).alias("flag"))


@query("detokenized_documents", """
WITH t AS (SELECT doc_id, '( ' || replace(text, '.', ' .') || ' )' AS s FROM documents)
SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(replace(s, ' n''t', 'n''t'), ' )', ')'), '( ', '('), '" ', '"'), ' "', '"'), ' ([''.,])', '\\1', 'g')) AS text_md5 FROM t""")
def detokenized_documents(spark, sf_dir):
    spaced = F.concat(F.lit("( "), F.replace("text", F.lit("."), F.lit(" .")), F.lit(" )"))
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.md5(strings.detokenize(spaced)).alias("text_md5"))


@query("limited_replacement", """
WITH t AS (SELECT doc_id, string_split(text, 'e') AS p FROM documents)
SELECT doc_id, md5(array_to_string(p[:4], '_') || CASE WHEN len(p) > 4 THEN 'e' || array_to_string(p[5:], 'e') ELSE '' END) AS three_md5,
  md5(array_to_string(p, '_')) AS all_md5 FROM t""")
def limited_replacement(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents", heavy=True).select(
        "doc_id", F.md5(strings.replace_first(text, "e", "_", 3)).alias("three_md5"),
        F.md5(strings.replace_first(text, "e", "_", 0)).alias("all_md5"),
    )


@query("argument_strings", """
SELECT p_partkey, 'name' AS k0, p_name AS v0, 'str' AS t0, CAST(p_size AS VARCHAR) AS v1, 'int' AS t1,
  CASE WHEN p_partkey % 2 = 0 THEN 'True' ELSE '0.5' END AS v2, CASE WHEN p_partkey % 2 = 0 THEN 'bool' ELSE 'float' END AS t2,
  p_name || '\\,' || p_type AS escaped_first FROM part""")
def argument_strings(spark, sf_dir):
    flag = F.when(F.col("p_partkey") % 2 == 0, F.lit("True")).otherwise(F.lit("0.5"))
    text = F.concat(F.lit("name="), "p_name", F.lit(",size="), F.col("p_size").cast("string"), F.lit(",,f="), flag)
    parsed = strings.parse_arguments(text)
    escaped = strings.escaped_split(F.concat("p_name", F.lit("\\,"), "p_type", F.lit(",rest")), ",")
    rows = table(spark, sf_dir, "part").select("p_partkey", parsed.alias("a"), escaped.alias("e"))
    a = F.col("a")
    return rows.select(
        "p_partkey", a[0]["key"].alias("k0"), a[0]["value"].alias("v0"), a[0]["kind"].alias("t0"), a[1]["value"].alias("v1"),
        a[1]["kind"].alias("t1"), a[2]["value"].alias("v2"), a[2]["kind"].alias("t2"), F.col("e")[0].alias("escaped_first"),
    )


@query("run_name_parts", """
SELECT o_orderkey, o_orderpriority AS task, strftime(o_orderdate, '%Y%m%d') AS "time", 'acc' AS metric, concat('t_', o_orderstatus, '_Test') AS config
FROM orders""")
def run_name_parts(spark, sf_dir):
    name = F.concat(F.lit("samples_"), "o_orderpriority", F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".jsonl"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", strings.run_task(name).alias("task"), strings.run_time(name).alias("time"),
        strings.drop_default_filter(F.lit("acc,none")).alias("metric"),
        strings.config_name(F.concat(F.lit("t_"), "o_orderstatus"), "test").alias("config"),
    )


@query("subtask_names", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Not Specified' WHEN contains(lower(p_name), 'red') THEN 'Red' WHEN contains(lower(p_name), 'bolt') THEN 'BOLT' ELSE 'Further Insights' END AS subtask FROM part""")
def subtask_names(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 5 != 0, F.upper("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", prompts.subtask_name(raw, ["Red", "BOLT"]).alias("subtask"))


@query("stringified_samples", """
SELECT o_orderkey, '["' || CAST(o_custkey AS VARCHAR) || '","' || o_orderstatus || '"]' AS leaves, '{"score":' || CASE WHEN o_custkey % 2 = 0 THEN 'null' ELSE CAST(o_custkey AS VARCHAR) END || '}' AS as_json FROM orders""")
def stringified_samples(spark, sf_dir):
    leaves = strings.stringify_leaves(F.array(F.array(F.col("o_custkey").cast("string"), F.col("o_orderstatus"))), 2)
    score = F.when(F.col("o_custkey") % 2 != 0, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_json(F.get(leaves, F.lit(0))).alias("leaves"), strings.clean_json(F.struct(score.alias("score"))).alias("as_json")
    )


@query("rolling_token_windows", """
WITH t AS (SELECT doc_id, string_split(text, ' ') AS k FROM documents), n AS (SELECT *, len(k) AS n FROM t),
w AS (SELECT doc_id, k, n, CAST(unnest(range(0, CASE WHEN n > 64 THEN 1 + CAST(ceil((n - 64) / 57.0) AS BIGINT) ELSE 1 END)) AS INT) AS win FROM n),
e AS (SELECT *, CASE WHEN win = 0 THEN least(n, 64) ELSE least(n - (64 + (win - 1) * 57), 57) END AS size,
  CASE WHEN win = 0 THEN least(n, 64) ELSE least(n, 64 + win * 57) END AS stop FROM w),
s AS (SELECT doc_id, win, CASE WHEN win = 0 THEN list_concat(['<s>'], k[1:stop - 1]) ELSE k[stop - 64:stop - 1] END AS inp, k[stop - size + 1:stop] AS pred FROM e)
SELECT doc_id, win, len(inp) AS n_input, len(pred) AS n_predicted, md5(array_to_string(inp, ' ')) AS input_md5, md5(array_to_string(pred, ' ')) AS predicted_md5,
  len(inp) - (len(pred) - 1) AS n_disjoint FROM s""")
def rolling_token_windows(spark, sf_dir):
    found = windows.rolling_windows(F.split("text", " "), F.lit("<s>"), longest=64, context=8)
    rows = table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.posexplode(found).alias("win", "w"))
    return rows.select(
        "doc_id", "win", F.size("w.input").cast("bigint").alias("n_input"), F.size("w.predicted").cast("bigint").alias("n_predicted"),
        F.md5(F.array_join("w.input", " ")).alias("input_md5"), F.md5(F.array_join("w.predicted", " ")).alias("predicted_md5"),
        F.size(windows.disjoint_input(F.col("w"))).cast("bigint").alias("n_disjoint"),
    )


@query("sample_tables", f"""
WITH {CHOICE_SQL}
SELECT c.doc_id AS id, c.task AS "data", '0. ' || c0 || chr(10) || '1. ' || c1 || chr(10) || '2. ' || c2 || chr(10) || '3. ' || c3 AS choices, len(c.task) AS input_len, c.gold AS labels,
  'multiple_choice' AS output_type, CAST(list_position(l, list_max(l)) - 1 AS BIGINT) AS raw_predictions, CAST(list_position(u, list_max(u)) - 1 AS BIGINT) AS filtered_predictions,
  CAST(s.pred = s.gold AS INT)::DOUBLE AS acc FROM c JOIN s USING (doc_id)""")
def sample_tables(spark, sf_dir):
    rows = derived(spark, sf_dir, CHOICES).join(choice_rows(spark, sf_dir).select("doc_id", "acc"), "doc_id")
    shaped = rows.select(
        "doc_id", F.col("task").alias("input"), F.array("c0", "c1", "c2", "c3").alias("choices"), F.col("gold").alias("target"),
        F.array("l0", "l1", "l2", "l3").alias("resps"), F.array("u0", "u1", "u2", "u3").alias("filtered_resps"), "acc",
    )
    out = results.sample_table(shaped, "multiple_choice", ["acc"])
    return out.withColumn("input_len", F.col("input_len").cast("bigint"))
