"""Models by name."""

from __future__ import annotations

from packetloom.models.autoencoder import AutoencoderModel
from packetloom.models.base import AnomalyModel
from packetloom.models.forest import RandomForestModel
from packetloom.models.svm import SVMModel

MODELS: dict[str, type[AnomalyModel]] = {
    model.model_type: model for model in (AutoencoderModel, RandomForestModel, SVMModel)
}


def model_class(name: str) -> type[AnomalyModel]:
    """The class of a name, in any case; ValueError for an unknown one."""
    found = MODELS.get(name.lower())
    if found is None:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(MODELS))}")
    return found


def register_model(model: type[AnomalyModel]) -> type[AnomalyModel]:
    """Makes a user's own model known under its ``model_type``."""
    if not issubclass(model, AnomalyModel):
        raise TypeError(f"{model.__name__} is not an AnomalyModel")
    MODELS[model.model_type.lower()] = model
    return model


def build_model(name: str, **parameters) -> AnomalyModel:
    return model_class(name)(**parameters)
