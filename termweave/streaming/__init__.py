"""Extensions for streams of terms: coefficients and counts are additive, so both are plain stateful aggregations."""
