"""Names, lists and patterns the results depend on.

Nothing here is computed.  Results are comparable with published feature files
only while these values stay as they are.
"""

# The nine semantic column types and their codes.
LABEL_CODES = {
    "numeric": 0,
    "categorical": 1,
    "datetime": 2,
    "sentence": 3,
    "url": 4,
    "embedded-number": 5,
    "list": 6,
    "not-generalizable": 7,
    "context-specific": 8,
}

# Number of sample values per column, and votes that make a flag true.
SAMPLE_COUNT = 5
VOTES_NEEDED = 3

# Statistics of a column, new name -> legacy name, in output order.
PROFILE_NAMES = {
    "name": "Attribute_name",
    "count": "total_vals",
    "nans": "num_nans",
    "nans_percent": "%_nans",
    "distinct": "num_of_dist_val",
    "distinct_percent": "%_dist_val",
    "mean": "mean",
    "std": "std_dev",
    "min": "min_val",
    "max": "max_val",
}

# Text features of a column, new name -> legacy name, in output order.
SAMPLE_FEATURE_NAMES = {
    "sample_0": "sample_1",
    "sample_1": "sample_2",
    "sample_2": "sample_3",
    "sample_3": "sample_4",
    "sample_4": "sample_5",
    "is_delimited": "has_delimiters",
    "is_url": "has_url",
    "is_email": "has_email",
    "is_datetime": "has_date",
    "mean_word_count": "mean_word_count",
    "std_word_count": "std_dev_word_count",
    "mean_stopword_count": "mean_stopword_total",
    "std_stopword_count": "stdev_stopword_total",
    "mean_char_count": "mean_char_count",
    "std_char_count": "stdev_char_count",
    "mean_whitespace_count": "mean_whitespace_count",
    "std_whitespace_count": "stdev_whitespace_count",
    "mean_delimiter_count": "mean_delim_count",
    "std_delimiter_count": "stdev_delim_count",
    "is_list": "is_list",
    "is_long_sentence": "is_long_sentence",
}

FLAG_FEATURES = ["is_delimited", "is_url", "is_email", "is_datetime"]
COUNT_FEATURES = [
    "word_count",
    "stopword_count",
    "char_count",
    "whitespace_count",
    "delimiter_count",
]

# The 25 statistics that feed the classical models, in order.
STATS_25 = [
    "total_vals",
    "num_nans",
    "%_nans",
    "num_of_dist_val",
    "%_dist_val",
    "mean",
    "std_dev",
    "min_val",
    "max_val",
    "has_delimiters",
    "has_url",
    "has_email",
    "has_date",
    "mean_word_count",
    "std_dev_word_count",
    "mean_stopword_total",
    "stdev_stopword_total",
    "mean_char_count",
    "stdev_char_count",
    "mean_whitespace_count",
    "stdev_whitespace_count",
    "mean_delim_count",
    "stdev_delim_count",
    "is_list",
    "is_long_sentence",
]

# The 19 statistics of the sequence model, legacy name -> model name.
STATS_19 = {
    "total_vals": "total_vals",
    "num_nans": "num_nans",
    "%_nans": "scaled_perc_nans",
    "num_of_dist_val": "num_of_dist_val",
    "%_dist_val": "%_dist_val",
    "mean": "scaled_mean",
    "std_dev": "scaled_std_dev",
    "min_val": "scaled_min",
    "max_val": "scaled_max",
    "mean_word_count": "scaled_mean_token_count",
    "std_dev_word_count": "scaled_std_dev_token_count",
    "mean_stopword_total": "scaled_mean_stopword_total",
    "mean_whitespace_count": "scaled_mean_whitespace_count",
    "mean_char_count": "scaled_mean_char_count",
    "mean_delim_count": "scaled_mean_delim_count",
    "stdev_stopword_total": "scaled_stdev_stopword_total",
    "stdev_whitespace_count": "scaled_stdev_whitespace_count",
    "stdev_char_count": "scaled_stdev_char_count",
    "stdev_delim_count": "scaled_stdev_delim_count",
}

# Model columns of STATS_19 that are clipped at 10,000 and then scaled.
STATS_19_SCALED = [
    "total_vals",
    "num_nans",
    "num_of_dist_val",
    "scaled_mean",
    "scaled_std_dev",
    "scaled_min",
    "scaled_max",
]

# Columns searched for unprintable characters.
TEXT_COLUMNS = ["Attribute_name", "sample_1", "sample_2", "sample_3", "sample_4", "sample_5"]

# Patterns.  They are written so that Java, RE2 and Python read them alike.
DELIMITED_PATTERN = r"^[^,;|]+[,;|][^,;|]"
DELIMITER_PATTERN = r"[,;|]"
URL_PATTERN = r"^(http|ftp|https)://[\p{L}\p{N}_-]+\.[\p{L}\p{N}_-]"
EMAIL_PATTERN = (
    r"^[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,6}([^\p{L}\p{N}_]|$)"
)
TOKEN_PATTERN = r"'?[\p{L}\p{N}_]+"
UNPRINTABLE_PATTERN = r"[^\x09-\x0d\x20-\x7e]"
NAN_TEXT_PATTERN = r"^[\x00-\x20]*([+-]?NaN|[nN][aA][nN])[\x00-\x20]*\z"
BLANK_RUN_PATTERN = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2,}"
)

# Accepted date shapes with the Spark and the strptime format.
DATE_SHAPES = [
    (r"^\d{4}-\d{2}-\d{2}\z", "yyyy-MM-dd", "%Y-%m-%d"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\z", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    (r"^\d{4}/\d{2}/\d{2}\z", "yyyy/MM/dd", "%Y/%m/%d"),
    (r"^\d{2}/\d{2}/\d{4}\z", "MM/dd/yyyy", "%m/%d/%Y"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}\z", "MMM d, yyyy", "%b %-d, %Y"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}\z", "d MMM yyyy", "%-d %b %Y"),
]
YEAR_PATTERN = r"^[0-9]{4}\z"
SECOND_FRACTION_PATTERN = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})\.\d{1,9}\z"
LONGEST_DATE = 29

# The public English stop word list, without the words that hold an
# apostrophe (a tokenizer cuts those up, so they never match).
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn "
    "hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()

# Hyper-parameter grids.
LOGISTIC_C = [0.0001, 0.001, 0.01, 0.1, 1, 10, 100, 1000, 10000, 100000]
FOREST_TREES = [5, 25, 50, 75, 100, 500]
FOREST_DEPTHS = [5, 10, 25, 50, 100, 250]
SVM_C = [0.1, 1, 10, 100, 1000]
SVM_GAMMA = [0.0001, 0.001, 0.01, 0.1, 1, 10]
NEIGHBOUR_ALPHAS = [0.001, 0.01, 0.1, 1, 10, 100, 1000]
NEIGHBOUR_COUNTS = list(range(1, 11))

# Clip limits, folds, hold-out share and seed, sequence length.
KNN_CLIP = 1000
STATS_CLIP = 10000
FOLDS = 5
HOLDOUT_SHARE = 0.25
SEED = 100
SEQUENCE_LENGTH = 256
LIST_MAX_CHARS = 100
SENTENCE_MIN_WORDS = 10
