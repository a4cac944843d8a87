"""DataFrame-to-DataFrame operators: normalise, audit, pair, aggregate, infer, sample, stratify."""
