"""Training-corpus operators: contamination, language models, fingerprints, tokenisation,
classifiers, archives, secrets, near duplicates and token stores.

Nothing outside this subpackage imports it.
"""
