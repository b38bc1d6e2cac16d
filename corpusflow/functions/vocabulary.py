"""Label vocabularies and rule tables."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TagRules:
    """Which labels the words of a tag stand for, in canonical label order."""

    rules: tuple[tuple[str, tuple[str, ...]], ...]
    whole_tag_keywords: frozenset[str] = frozenset()
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    residual: tuple[str, tuple[str, ...]] | None = None
    normal_tokens: tuple[str, ...] = ("normal",)
    unindexed_tokens: tuple[str, ...] = ()
    healthy: str = "No Finding"
    other: str = "Other"
    unlabeled: str = "Unlabeled"


@dataclass(frozen=True)
class Vocabulary:
    """Main labels in canonical order plus the exclusive and fallback ones."""

    labels: tuple[str, ...]
    healthy: str = "No Finding"
    fallbacks: tuple[str, ...] = ("Other", "Unlabeled")

    @property
    def scored(self) -> tuple[str, ...]:
        return (*self.labels, self.healthy)

    @property
    def allowed(self) -> tuple[str, ...]:
        return (*self.scored, *self.fallbacks)


# Tag keywords per clinical label.
CLINICAL_TAGS = TagRules(
    rules=(
        ("Pneumothorax", ("pneumothorax",)),
        ("Pleural Effusion", ("pleural effusion", "effusion", "hydrothorax")),
        ("Edema", ("edema", "pulmonary congestion", "vascular congestion")),
        ("Consolidation", ("consolidation", "airspace disease", "air space disease")),
        ("Pneumonia", ("pneumonia",)),
        ("Atelectasis", ("atelectasis", "atelectases")),
        ("Lung Lesion", ("nodule", "mass", "granuloma", "granulomatous", "lesion")),
        ("Lung Opacity", ("opacity", "opacities", "infiltrate", "infiltration", "density",
                          "densities", "fibrosis", "scarring", "interstitial", "reticular")),
        ("Cardiomegaly", ("cardiomegaly",)),
        ("Enlarged Cardiomediastinum", ("mediastinum", "mediastinal", "cardiomediastin")),
        ("Fracture", ("fracture",)),
        ("Pleural Other", ("pleural thickening",)),
        ("Support Devices", ("catheter", "device", "pacemaker", "tube", "picc", "port", "sternotomy",
                             "surgical", "suture", "clip", "stent", "prosthesis", "implant")),
    ),
    whole_tag_keywords=frozenset({"interstitial", "reticular"}),
    aliases={"pneumothorax": ("pneumothorax", "hydropneumothorax", "hemopneumothorax")},
    residual=("Pleural Other", ("pleura", "pleural")),
    unindexed_tokens=("no indexing", "technical quality of image unsatisfactory"),
)

CLINICAL = Vocabulary(labels=tuple(label for label, _ in CLINICAL_TAGS.rules))
