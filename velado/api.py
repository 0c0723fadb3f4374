"""The two engines as objects, for users who hold one per job: options once, then frames in and out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import extract_names
from .operators import batch, layout, text_mode
from .operators.document_mode import DocOptions, mask
from .plans.cut import written


class TextAnonymizer:
    """Reversible mode. Scopes keep their numbering from one `anonymize` to the next, by the vault alone: no text is kept, and
    a later session goes on from a stored vault. Any failure raises; no text comes back half done.
    """

    def __init__(self, spark: SparkSession, types: Iterable[str] = text_mode.TYPES, vault: DataFrame | None = None):
        self.spark, self.types = spark, tuple(types)
        self.vault = spark.createDataFrame([], text_mode.VAULT) if vault is None else vault
        self._empty = vault is None

    def anonymize(self, calls: DataFrame) -> DataFrame:
        """calls (scope_id, seq, text, ...): rows after those of earlier calls in each scope."""
        done, vault = text_mode.anonymize(calls, self.types, None if self._empty else self.vault)
        self.vault, self._empty = written(vault, "vault"), False
        return done

    def restore(self, replies: DataFrame) -> DataFrame:
        return text_mode.restore(replies, self.vault)

    def counts(self) -> DataFrame:
        return text_mode.counts(self.vault)

    def has_personal_data(self) -> bool:
        return not self.vault.isEmpty()


class DocumentAnonymizer:
    """Irreversible mode with one set of options. first_names: what names found by shape begin with; needed where `nomes` is
    set (see document_mode.mask)."""

    def __init__(self, options: dict | DocOptions | None = None, first_names: Column | Iterable[str] | None = None):
        self.options = options if isinstance(options, DocOptions) else DocOptions.of(options)
        self.first_names = first_names

    def mask(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return mask(df, text_col, self.options, self.first_names)

    def names(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return df.withColumn("names", extract_names(F.col(text_col), self.first_names if self.first_names is not None else ()))

    def process(self, spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
        """Masks the files under a path and reports on each."""
        return batch.run(spark, path, self.options, recursive, self.first_names)

    def plan(self, pages: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(boxes, terms), to be edited before `apply`."""
        return layout.plan(pages, words, self.options, self.first_names)

    def apply(self, boxes: DataFrame, terms: DataFrame, annots: DataFrame | None = None, metadata: DataFrame | None = None, links: DataFrame | None = None, images: DataFrame | None = None) -> dict[str, DataFrame]:
        """What a writer needs of a plan: drawn boxes, and the annotations, metadata, links and images that stay, as the
        options say."""
        out = {"redactions": layout.redactions(boxes, self.options.modo_redacao_pdf)}
        if annots is not None:
            out["annotations"] = layout.kept_annotations(annots, boxes, terms) if self.options.limpar_anotacoes else annots
        if metadata is not None:
            out["metadata"] = layout.scrubbed_metadata(metadata, terms, self.options, self.first_names) if self.options.sanitizar_metadados else metadata
        if links is not None:
            out["links"] = layout.kept_links(links, self.options)
        if images is not None:
            out["images"] = layout.image_cuts(images, boxes, self.options)
        return out
