"""Error texts."""

# Texts that existing callers match on.
POSITION_TOO_LARGE = (
    "The list of indices can only contain elements within the amount of columns. "
    "Index {i} is greater than the total of columns."
)
NO_ROLES = "Inputs and outputs columns lists to validate must not be empty"
TOO_MANY_ROLES = (
    "Inputs and outputs cannot have more elements than names. "
    "Number of inputs: {inputs}, number of outputs: {outputs}, number of names: {names}. "
)
UNKNOWN_ROLES = (
    "Inputs and outputs can only contain elements that exist in names. Extra elements: {extra}"
)
UNKNOWN_COLUMN = "Error while changing column types: column '{name}' does not exist in dataset."
NO_SEPARATOR = "Error trying to load the CSV dataset: separator parameter was not provided."
LENGTHS = (
    "The length of the true labels and the predicted labels must be equal, "
    "given: len(true_labels) = {truth} and len(pred_labels) = {predicted}."
)

# Our own.
SAMPLE_TOO_LARGE = "a sample of {n} rows was asked for; it has to be less than or equal to the {total} rows there are"
RANGE_FORMAT = "the format of a range is 3 or 2-5; several are separated by commas"
RANGE_TOO_LARGE = "positions in a range should be minor or equal to the number of rows or columns"
RANGE_ORDER = "the second number of a range may not lie below its start"
SEPARATOR_TYPE = "the separator should be a string, not {got}"
PERCENTILES = "the upper percentile has to lie above the lower one"
UNKNOWN_SPLIT_NAME = "Error: there is no split called {name}"
UNKNOWN_STATUS = "Error: {code} is no run state"
