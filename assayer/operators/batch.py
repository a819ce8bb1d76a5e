"""Schedules, request rows, packing into files, and answers of batch runs. What needs a network stays outside."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scalars import json_object_in


def rating_schedule(tasks: DataFrame, aspects: list[str], trials: int = 1) -> DataFrame:
    """screen_task_id, trial, aspect, custom_id for every task, trial and aspect; with one trial the id leaves it out."""
    every = tasks.select("screen_task_id", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial")).select("*", F.explode(F.array(*map(F.lit, aspects))).alias("aspect"))
    trial = F.concat(F.lit("&trial"), F.col("trial").cast("string")) if trials > 1 else F.lit("")
    return every.withColumn("custom_id", F.concat("screen_task_id", trial, F.lit("&aspect="), "aspect"))


def parse_custom_id(custom_id: Column) -> Column:
    """struct(screen_task_id, trial, aspect) of an id; without an aspect the task itself stands for it."""
    parts = F.split(custom_id, "&")
    task = F.element_at(parts, 1)
    trial = F.when(F.size(parts) == 3, F.regexp_extract(F.element_at(parts, 2), r"(\d+)$", 1).try_cast("int"))
    aspect = F.when(F.size(parts) > 1, F.regexp_replace(F.element_at(parts, -1), "^aspect=", "")).otherwise(task)
    return F.struct(task.alias("screen_task_id"), trial.alias("trial"), aspect.alias("aspect"))


def fill_template(template: str, **values: Column) -> Column:
    """``template`` with {name} replaced by the values; a null value gives a null text."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _set(line: Column, name: str, value: Column) -> Column:
    """The JSON object ``line`` with one more field, whose ``value`` is JSON; unchanged if it is null."""
    return F.coalesce(F.concat(F.left(line, F.length(line) - 1), F.lit(f',"{name}":'), value, F.lit("}")), line)


def _literal(value) -> Column:
    return F.lit(None).cast("string") if value is None else F.lit(json.dumps(value, ensure_ascii=False))


def _parts(prompt: Column, images: Column | None, text_part: Column, image_part) -> Column:
    """The JSON array of a text part and one part per non-null image, in order: the last one is the target."""
    if images is None:
        return F.concat(F.lit("["), F.to_json(text_part), F.lit("]"))
    shown = F.transform(F.filter(F.coalesce(images, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.to_json(image_part(x)))
    return F.concat(F.lit("["), F.array_join(F.concat(F.array(F.to_json(text_part)), shown), ","), F.lit("]"))


def chat_request(custom_id: Column, model: str, system: str, prompt: Column, temperature: float | None = None, max_tokens: int | None = None, images: Column | None = None, image_format: str = "jpeg", schema: dict | None = None) -> Column:
    """One request line of the chat shape as JSON. Without ``images`` the user's content is a plain text; ``schema`` is that of the answer."""
    url = lambda x: F.struct(F.concat(F.lit(f"data:image/{image_format};base64,"), x).alias("url"))
    parts = _parts(prompt, images, F.struct(F.lit("text").alias("type"), prompt.alias("text")), lambda x: F.struct(F.lit("image_url").alias("type"), url(x).alias("image_url")))
    user = _set(F.lit('{"role":"user"}'), "content", F.regexp_replace(F.to_json(F.array(prompt)), r"(?s)^\[(.*)\]$", "$1") if images is None else parts)
    said = F.to_json(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    body = _set(F.lit(json.dumps({"model": model})), "messages", F.concat(F.lit("["), said, F.lit(","), user, F.lit("]")))
    for name, value in (("temperature", temperature), ("response_format", None if schema is None else {"type": "json_schema", "json_schema": schema}), ("max_completion_tokens", max_tokens)):
        body = _set(body, name, _literal(value))
    return _set(F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"))), "body", body)


def content_parts_request(custom_id: Column, model: str, system: str, prompt: Column, temperature: float | None = None, max_tokens: int | None = None, images: Column | None = None, image_format: str = "jpeg", schema: dict | None = None) -> Column:
    """One request line of the shape with parts and a system instruction."""
    inline = lambda x: F.struct(F.struct(F.lit(f"image/{image_format}").alias("mimeType"), x.alias("data")).alias("inlineData"))
    contents = F.concat(F.lit("["), _set(F.lit('{"role":"user"}'), "parts", _parts(prompt, images, F.struct(prompt.alias("text")), inline)), F.lit("]"))
    request = _set(F.lit(json.dumps({"model": f"models/{model}"})), "contents", contents)
    request = _set(request, "systemInstruction", _literal({"role": "user", "parts": [{"text": system}]}))
    config = {"temperature": temperature, "maxOutputTokens": max_tokens} | ({} if schema is None else {"responseMimeType": "application/json", "responseJsonSchema": schema["schema"]})
    request = _set(request, "generation_config", _literal({k: v for k, v in config.items() if v is not None}))
    return _set(F.to_json(F.struct(custom_id.alias("key"))), "request", request)


def messages_request(custom_id: Column, model: str, system: str, prompt: Column, temperature: float | None = None, max_tokens: int | None = None, images: Column | None = None, image_format: str = "jpeg") -> Column:
    """One request line of the shape with parameters and messages."""
    source = lambda x: F.struct(F.lit("base64").alias("type"), F.lit(f"image/{image_format}").alias("media_type"), x.alias("data"))
    parts = _parts(prompt, images, F.struct(F.lit("text").alias("type"), prompt.alias("text")), lambda x: F.struct(F.lit("image").alias("type"), source(x).alias("source")))
    params = F.lit(json.dumps({k: v for k, v in {"model": model, "max_tokens": max_tokens, "temperature": temperature, "system": system}.items() if v is not None}))
    params = _set(params, "messages", F.concat(F.lit("["), _set(F.lit('{"role":"user"}'), "content", parts), F.lit("]")))
    return _set(F.to_json(F.struct(custom_id.alias("custom_id"))), "params", params)


def parse_data_url(url: Column) -> Column:
    """struct(format, data) of a data URL of an image; null if it is none."""
    pattern = r"(?s)^data:image/([^;]+);base64,(.*)"
    return F.when(url.rlike(pattern), F.struct(F.regexp_extract(url, pattern, 1).alias("format"), F.regexp_extract(url, pattern, 2).alias("data")))


def preview(line: Column) -> Column:
    """struct(custom_id, model, temperature, max_tokens, system, text, images) of a request line of any shape; images are structs of label, format and data.

    Texts of several parts are joined by line breaks; the last image is the target, those before it are samples.
    """
    get = lambda *paths: F.coalesce(*(F.get_json_object(line, p) for p in paths))
    part = "struct<type:string,text:string,image_url:struct<url:string>,source:struct<media_type:string,data:string>,inlineData:struct<mimeType:string,data:string>>"
    raw = get("$.body.messages[1].content", "$.params.messages[0].content", "$.request.contents[0].parts")
    parts = F.coalesce(F.when(raw.startswith("["), F.from_json(raw, f"array<{part}>")), F.array().cast(f"array<{part}>"))
    plain = lambda kind: F.regexp_replace(F.coalesce(kind, F.lit("image/jpeg")), "^image/", "")
    url = lambda p: parse_data_url(p["image_url"]["url"])
    image = lambda p: F.when(p["source"].isNotNull(), F.struct(plain(p["source"]["media_type"]).alias("format"), p["source"]["data"].alias("data"))).when(
        p["inlineData"].isNotNull(), F.struct(plain(p["inlineData"]["mimeType"]).alias("format"), p["inlineData"]["data"].alias("data"))
    ).otherwise(url(p))
    found = F.filter(F.transform(parts, image), lambda x: x.isNotNull())
    labelled = F.transform(found, lambda x, i: F.struct(F.when(i == F.size(found) - 1, "target image").otherwise(F.concat(F.lit("sample image "), (i + 1).cast("string"))).alias("label"), x["format"].alias("format"), x["data"].alias("data")))
    text = F.when(raw.startswith("["), F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")).otherwise(raw)
    return F.struct(
        get("$.custom_id", "$.key").alias("custom_id"), get("$.body.model", "$.params.model", "$.request.model").alias("model"), get("$.body.temperature", "$.params.temperature", "$.request.generation_config.temperature").cast("double").alias("temperature"),
        get("$.body.max_completion_tokens", "$.params.max_tokens", "$.request.generation_config.maxOutputTokens").cast("int").alias("max_tokens"),
        get("$.body.messages[0].content", "$.params.system", "$.request.systemInstruction.parts[0].text").alias("system"), text.alias("text"), labelled.alias("images"),
    )


def prompt_rows(responses: DataFrame, schedule: DataFrame, screens: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """The rows to ask about: ``responses`` with their schedule (by screen_task_id) and screen (by screen_id), without the screens of ``samples`` and without
    rows that lack an id, a task or an image."""
    rows = responses.join(schedule, "screen_task_id", "left").join(screens, "screen_id", "left")
    if samples is not None:
        rows = rows.join(samples.select("screen_id").distinct(), "screen_id", "left_anti")
    return rows.where("custom_id IS NOT NULL AND trim(coalesce(task, '')) <> '' AND base64_screen IS NOT NULL")


#: The columns that an answer about an aspect fills. Fixed values.
FILLED = {"aesthetics_rating": ("aesthetics_rating",), "usability_rating": ("learnability", "efficiency", "usability_rating"), "design_quality_rating": ("design_quality_rating",)}


def ratings_of(records: DataFrame, order: list[str]) -> DataFrame:
    """screen_task_id, trial and the five ratings from ``records`` (custom_id, text and the columns of ``order``), the last answer of an aspect counting.

    A rating is null where its answer is missing, no JSON, or lacks the key.
    """
    last = latest_answers(records.select("custom_id", "text", *order), "custom_id", order).withColumn("p", parse_custom_id(F.col("custom_id"))).withColumn("j", json_object_in(F.col("text")))
    columns = [F.max(F.when(F.col("p.aspect") == aspect, F.get_json_object("j", f"$.{c}")).try_cast("double")).alias(c) for aspect, names in FILLED.items() for c in names]
    return last.groupBy(F.col("p.screen_task_id").alias("screen_task_id"), F.col("p.trial").alias("trial")).agg(*columns)


#: What is kept of an attempt, and what a job loses with it.
ATTEMPT = ("input_file_id", "batch_id", "status", "created_at", "retrieved_at", "error", "check_failures")


def archive_attempts(jobs: DataFrame, failed: Column, now: Column) -> DataFrame:
    """``jobs`` (the columns ATTEMPT and attempts, an array of them with archived_at) where those that ``failed`` are ready to be submitted again: the attempt is added to attempts."""
    attempt = F.struct(*(F.col(c).alias(c) for c in ATTEMPT), now.alias("archived_at"))
    kept = F.when(failed & F.col("batch_id").isNotNull(), F.array_append(F.coalesce("attempts", F.array().cast(dict(jobs.dtypes)["attempts"])), attempt)).otherwise(F.col("attempts"))
    fresh = {c: F.lit(None) for c in ("input_file_id", "batch_id", "created_at", "retrieved_at", "error")} | {"status": F.lit("retry_pending"), "check_failures": F.lit(0)}
    types = dict(jobs.dtypes)
    return jobs.select(*(kept.alias(c) if c == "attempts" else F.when(failed, fresh[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in jobs.columns))


def pack_lines(lines: DataFrame, key: str, line: str, cap: int, partitions: int = 32) -> DataFrame:
    """key, file, place: lines put into files of at most ``cap`` bytes with their line breaks, in the order of ``key`` within each of ``partitions`` streams.

    A line that alone is longer has a file of its own. Streams are packed side by side, so no task sees all lines; a stream is a range of keys and its
    files are numbered within it.
    """
    kind = dict(lines.dtypes)[key]
    sized = lines.select(F.col(key).alias("key"), (F.octet_length(line) + 1).alias("bytes")).repartitionByRange(partitions, "key").sortWithinPartitions("key")
    streams = sized.withColumn("stream", F.spark_partition_id())

    def fold(batches: Iterator) -> Iterator:
        number, used, place = 1, 0, 0
        for batch in batches:
            files, places = [], []
            for n in batch["bytes"]:
                if used and used + n > cap:
                    number, used, place = number + 1, 0, 0
                used, place = used + int(n), place + 1
                files.append(number)
                places.append(place)
            yield batch.assign(file=files, place=places)[["key", "stream", "file", "place", "bytes"]]

    return streams.mapInPandas(fold, f"key {kind}, stream int, file int, place int, bytes long").withColumnRenamed("key", key)


def latest_answers(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key by ``order``. One aggregate, so a key with many retries is no hot spot."""
    rest = [c for c in records.columns if c not in (key, *order)]
    best = records.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("b"))
    return best.select(key, *(F.col(f"b.{c}").alias(c) for c in (*order, *rest)))


def content_of(record: Column) -> Column:
    """The answer's text in a JSON record, whichever provider's shape it has."""
    shapes = ("$.response.candidates[0].content.parts[0].text", "$.response.body.choices[0].message.content", "$.result.message.content[0].text")
    return F.coalesce(*(F.get_json_object(record, s) for s in shapes))


def answer_error(record: Column, required: dict[str, list[str] | None]) -> Column:
    """Why the answer in a record is of no use; null if it is. ``required`` has the fields in order, each with its allowed values or none."""
    status, content = F.get_json_object(record, "$.response.status_code"), content_of(record)
    body = json_object_in(content)
    out = (
        F.when((status != "200"), F.concat(F.lit("http status "), status))
        .when(F.get_json_object(record, "$.error").isNotNull(), "provider error")
        .when(F.coalesce(content, F.lit("")) == "", "missing content")
        .when(body.isNull(), "invalid json")
    )
    for field, allowed in required.items():
        value = F.get_json_object(body, f"$.{field}")
        out = out.when(value.isNull(), f"missing {field}")
        if allowed:
            out = out.when(~value.isin(*allowed), f"invalid {field}")
    return out


def upsert(table: DataFrame, answers: DataFrame, keys: list[str], columns: list[str], merge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``table`` with the non-null values of ``answers`` put into ``columns``. Keys of answers that the table lacks are left out.

    ``merge`` says what comes of the old and the new value where both are to be looked at.
    """
    new = answers.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    out = table.join(new, keys, "left")
    merge = merge or (lambda old, new: F.coalesce(new, old))
    return out.select(*(merge(F.col(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in table.columns))


def reconcile(jobs: DataFrame, most_failures: int = 3) -> DataFrame:
    """``jobs`` with what to do next: done, submit, give_up, unverified or running."""
    s = F.col("status")
    action = (
        F.when((s == "completed") & F.col("retrieved"), "done")
        .when(s.isin("failed", "expired", "cancelled") | (F.col("batch_id").isNull() & (F.col("check_failures") == 0)), "submit")
        .when(F.col("check_failures") >= most_failures, "give_up")
        .when(F.col("check_failures") > 0, "unverified")
        .otherwise("running")
    )
    return jobs.withColumn("next", action)


def few_shot(tasks: DataFrame, total: str, order: str, ends: int = 3) -> DataFrame:
    """The lowest and highest ``ends`` tasks by ``total`` and the one in the middle: section, and the columns of ``tasks``.

    The ends are top-k reports. The middle is found by counting totals; the ties of its total are cut into ranges of ``order``, and only the range in which
    it lies is sorted, so a frequent total is no task's burden.
    """
    low = tasks.orderBy(F.asc(total), F.asc(order)).limit(ends).withColumn("section", F.lit("low"))
    high = tasks.orderBy(F.desc(total), F.desc(order)).limit(ends).withColumn("section", F.lit("high"))
    counts = tasks.groupBy(total).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n")).first()[0] or 0
    # As many rows as there are totals.
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(total)) - F.col("n")
    spot = counts.withColumn("before", before).where((F.col("before") <= whole // 2) & (F.col("before") + F.col("n") > whole // 2)).first()
    if spot is None:
        return low.unionByName(high)
    ties, skip = tasks.where(F.col(total) == spot[total]), whole // 2 - spot.before
    # Ranges of the order: sorted by all tasks together, counted, and the one in which the middle lies is numbered.
    ranged = ties.repartitionByRange(64, order).withColumn("__range", F.spark_partition_id())
    sizes = sorted((r["__range"], r["n"]) for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).collect())
    for number, n in sizes:
        if skip < n:
            break
        skip -= n
    inside = ranged.where(F.col("__range") == number).drop("__range")
    mid = inside.orderBy(F.asc(order)).offset(int(skip)).limit(1).withColumn("section", F.lit("middle"))
    return low.unionByName(mid).unionByName(high)
