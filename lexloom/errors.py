"""Errors of the library; every one is a ``LexloomError``."""


class LexloomError(Exception):
    """Base of all errors raised here."""


def _kind(name: str, doc: str) -> type[LexloomError]:
    return type(name, (LexloomError,), {"__doc__": doc, "__module__": __name__})


ConfigurationError = _kind("ConfigurationError", "A setting or argument is not allowed.")
ModelLoadError = _kind("ModelLoadError", "A model or the package it needs is missing.")
UnsupportedLanguageError = _kind("UnsupportedLanguageError", "The language is not handled.")
VectorStoreError = _kind("VectorStoreError", "A collection rejects vectors or rows.")
IndexVersionError = _kind("IndexVersionError", "A collection was made with another embedding model or dimension.")
DocumentLoadError = _kind("DocumentLoadError", "A file can't be read as a document.")
EmbeddingError = _kind("EmbeddingError", "Embedding failed.")
RetrievalError = _kind("RetrievalError", "Retrieval or fusion failed.")
RerankingError = _kind("RerankingError", "Reranking failed.")
RAGError = _kind("RAGError", "A question can't be answered.")
