"""Fixed values of the journal format: words, sentinels and column lists."""

# Alarm words, compared after trimming and lower-casing.
ALARM_TRUE = ["true", "t", "1", "yes", "y", "да", "истина"]
ALARM_FALSE = ["false", "f", "0", "no", "n", "нет", "ложь"]

# Numbers that devices send instead of a measurement.
SENTINELS = [-100.0, 100.0, 255.0, 999.0, 9999.0, -999.0]

# Counter column -> lower-cased text of the sensor state.
TEXT_STATES = {
    "fault_count": "неисправен",
    "no_power_count": "обесточен",
    "undefined_count": "неопределен",
    "off_count": "выключен",
    "on_count": "включен",
    "movement_detected_count": "обнаружено движение",
    "no_movement_count": "движения нет",
    "norm_count": "норма",
    "open_count": "не замкнут",
}

# Cells that a CSV reader with default settings treats as empty.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Strict decimal number: rejects "1d", "inf" and "1_000".
NUMBER_PATTERN = r"^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?$"

JOURNAL_COLUMNS = ["event_id", "channel_id", "date", "time", "alarm_raw", "sensor_value"]

VALUE_COUNTERS = [
    "events_count", "alarm_count", "numeric_count", "text_count",
    "missing_count", "negative_count", "sentinel_count",
]
DAILY_COUNTERS = VALUE_COUNTERS + list(TEXT_STATES)
DAILY_SUMS = DAILY_COUNTERS + ["value_sum", "value_sumsq"]

# Counters used by the object model.
MODEL_COUNTERS = [
    "events_count", "alarm_count", "fault_count", "no_power_count",
    "undefined_count", "numeric_count", "text_count", "off_count", "on_count",
    "movement_detected_count", "open_count",
]

ROLLING_COUNTERS = [
    "events_count", "alarm_count", "numeric_count", "text_count",
    "missing_count", "negative_count", "sentinel_count", "fault_count",
    "no_power_count", "undefined_count", "movement_detected_count", "open_count",
]

OBJECT_SIGNALS = [
    "alarm_today", "alarm_channels", "observed_channels",
    "fault_channels", "no_power_channels", "events_count",
]

# Texts that stand for a missing dictionary entry or a blank attribute.
NOT_IN_DICTIONARY = "Нет в справочнике"
UNSPECIFIED = "Не указан"

# Headers of the exported files -> names used here.
JOURNAL_HEADERS = {
    "ид_события": "event_id",
    "ид_канала_данных": "channel_id",
    "дата": "date",
    "время": "time",
    "тревожное": "alarm_raw",
    "значение_датчика": "sensor_value",
}
CHANNEL_HEADERS = {
    "ид_канала_данных": "channel_id",
    "тип_инж_системы": "engineering_system",
    "тип_датчика": "sensor_type",
    "ид_объект": "object_id",
}
OBJECT_HEADERS = {
    "ид_объект": "object_id",
    "вид_объекта": "object_kind",
    "родитель": "parent_id",
    "диспетчерское_название_объекта": "object_name",
}

# Fixed texts shown on forecast cards.
NOTE_NO_RECORDS = "Нет записей за день; исправность не подтверждена."
NOTE_RECORDS = "Наличие записей не гарантирует полное покрытие наблюдения."
NO_OBSERVATION = "Нет наблюдения"

# Fixed review rules: id, facts that support it, text with the facts' placeholders.
REVIEW_RULES = {
    "NO_RECORDS_TODAY": (
        ["observed_channels", "events_today"],
        "За день признаков записи не зарегистрированы. Проверьте доступность источника данных "
        "и журнал поступления. По отсутствию записей состояние оборудования не установлено."),
    "PARTIAL_CATALOG_RECORDS": (
        ["observed_channels", "catalog_channels"],
        "Записи есть по {observed_channels} из {catalog_channels} справочных каналов. "
        "Уточните ожидаемый режим регистрации и полноту поступления; отсутствие записей "
        "по каналу не доказывает неисправность."),
    "ALARM_RECORDED_TODAY": (
        ["current_alarm", "alarm_channels"],
        "В день признаков уже были тревожные записи. Сопоставьте их с журналом диспетчера "
        "и ранее принятыми решениями; необходимость осмотра определяет диспетчер."),
    "MULTIPLE_ALARM_DAYS": (
        ["alarm_days_7d", "observed_days_7d"],
        "За последние семь календарных дней тревожные записи отмечены в {alarm_days_7d} днях. "
        "Проверьте их повторяемость и предыдущую отработку по журналу."),
    "SELECTED_FOR_REVIEW": (
        ["warning"],
        "Объект включён в очередь проверки. Сопоставьте доступные наблюдения и журнал "
        "диспетчера; модельная оценка сама по себе не подтверждает поломку."),
    "OUTSIDE_WARNING_POLICY": (
        ["warning"],
        "Объект не выбран действующей политикой предупреждений. Отсутствие предупреждения "
        "не подтверждает исправность; дополнительных оснований для рекомендации "
        "в переданных фактах нет."),
}

# Field names that would leak outcomes into a release.
OUTCOME_FIELDS = [
    "outcome", "outcomes", "actual", "target_any_object_alarm_d_plus_2", "onset_target",
    "alarm_target", "joint_target", "quiet_intermediate", "records_intermediate", "records_target",
]
