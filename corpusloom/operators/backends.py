"""Backends of the model steps: local engines, hosted services and translation models.

Each client is made by a factory once per Python worker, imports its library only then, and is called with lists. A factory is a partial of the class, for example
``functools.partial(ChatService, "openai", "model-name")``. Keys and addresses come from the libraries' own environment variables.
"""

from __future__ import annotations

import importlib
from collections.abc import Sequence

from corpusloom.operators.inference import Sampling


def _library(name: str):
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise ImportError(f"this backend needs the library {name}") from e


class _TextOnly:
    """A backend without embeddings and scores."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError(f"{type(self).__name__} has no embeddings")

    def score(self, sources: list[str], candidates: list[str], references: list[str | None]) -> list[float]:
        raise NotImplementedError(f"{type(self).__name__} has no scores")


class ServingEngine(_TextOnly):
    """A local vLLM engine, split over ``tensor_parallel`` devices, with an adapter if its path is given; beams go through its beam search."""

    def __init__(self, model: str, tensor_parallel: int = 1, adapter: str | None = None, **settings):
        self.vllm = _library("vllm")
        self.engine = self.vllm.LLM(model=model, tensor_parallel_size=tensor_parallel, enable_lora=adapter is not None, **settings)
        self.adapter = _library("vllm.lora.request").LoRARequest("adapter", 1, adapter) if adapter else None

    def generate(self, prompts: list[str], sampling: Sampling) -> list[list[str]]:
        if sampling.num_beams > 1:
            beams = _library("vllm.sampling_params").BeamSearchParams(beam_width=sampling.num_beams, max_tokens=sampling.max_new_tokens)
            found = self.engine.beam_search([{"prompt": p} for p in prompts], beams)
            return [[s.text[len(p) :] if s.text.startswith(p) else s.text for s in f.sequences[: sampling.num_return_sequences]] for p, f in zip(prompts, found, strict=True)]
        settings = self.vllm.SamplingParams(
            n=sampling.num_return_sequences, temperature=sampling.temperature, top_p=sampling.top_p, repetition_penalty=sampling.repetition_penalty, max_tokens=sampling.max_new_tokens
        )
        return [[o.text for o in r.outputs] for r in self.engine.generate(prompts, settings, lora_request=self.adapter)]


class LocalModel(_TextOnly):
    """A transformers language model; Spark's partitions take the place of processes, one model per worker."""

    def __init__(self, model: str, device: str = "cpu", **settings):
        self.torch, library = _library("torch"), _library("transformers")
        self.tokenizer = library.AutoTokenizer.from_pretrained(model, padding_side="left")
        self.tokenizer.pad_token = self.tokenizer.pad_token or self.tokenizer.eos_token
        self.model, self.device = library.AutoModelForCausalLM.from_pretrained(model, **settings).to(device), device

    def generate(self, prompts: list[str], sampling: Sampling) -> list[list[str]]:
        inputs = self.tokenizer(prompts, return_tensors="pt", padding=True).to(self.device)
        random = {"do_sample": True, "temperature": sampling.temperature, "top_p": sampling.top_p} if sampling.temperature > 0 else {"do_sample": False}
        with self.torch.no_grad():
            out = self.model.generate(**inputs, max_new_tokens=sampling.max_new_tokens, num_beams=sampling.num_beams, num_return_sequences=sampling.num_return_sequences, repetition_penalty=sampling.repetition_penalty, **random)
        texts = self.tokenizer.batch_decode(out[:, inputs["input_ids"].shape[1] :], skip_special_tokens=True)
        return _grouped(texts, sampling.num_return_sequences)


class TranslationModel(_TextOnly):
    """A sequence-to-sequence translator that begins its output with the target language's code; outputs are at most twice as long as the longest input."""

    def __init__(self, model: str, source: str, target: str, beams: int = 5, device: str = "cpu"):
        library = _library("transformers")
        self.tokenizer = library.AutoTokenizer.from_pretrained(model, src_lang=source)
        self.model, self.device, self.target, self.beams = library.AutoModelForSeq2SeqLM.from_pretrained(model).to(device), device, target, beams

    def generate(self, prompts: list[str], sampling: Sampling) -> list[list[str]]:
        inputs = self.tokenizer(prompts, return_tensors="pt", padding=True).to(self.device)
        longest = max(int(sum(row)) for row in inputs["attention_mask"].tolist())
        beams = max(self.beams, sampling.num_return_sequences)
        out = self.model.generate(
            **inputs, forced_bos_token_id=self.tokenizer.convert_tokens_to_ids(self.target), max_new_tokens=2 * longest, num_beams=beams, num_return_sequences=sampling.num_return_sequences, do_sample=False
        )
        return _grouped(self.tokenizer.batch_decode(out, skip_special_tokens=True), sampling.num_return_sequences)


class ChatService(_TextOnly):
    """A hosted service by the name of its library: 'openai' (chat, or plain completions), 'anthropic' or 'cohere'. A failed call is repeated by generate()."""

    def __init__(self, service: str, model: str, system: str | None = None, completions: bool = False, **settings):
        if service not in ("openai", "anthropic", "cohere"):
            raise ValueError(f"unknown service {service}")
        library = _library(service)
        self.client = {"openai": "OpenAI", "anthropic": "Anthropic", "cohere": "ClientV2"}[service]
        self.client = getattr(library, self.client)(**settings)
        self.service, self.model, self.system, self.completions = service, model, system, completions

    def generate(self, prompts: list[str], sampling: Sampling) -> list[list[str]]:
        return [[self._one(p, sampling) for _ in range(sampling.num_return_sequences)] for p in prompts]

    def _one(self, prompt: str, s: Sampling) -> str:
        limits = {"model": self.model, "max_tokens": s.max_new_tokens, "temperature": s.temperature}
        said = [{"role": "user", "content": prompt}]
        told = [{"role": "system", "content": self.system}] if self.system else []
        if self.service == "anthropic":
            return self.client.messages.create(messages=said, **({"system": self.system} if self.system else {}), **limits).content[0].text
        if self.service == "cohere":
            return self.client.chat(messages=told + said, p=s.top_p, **limits).message.content[0].text
        if self.completions:
            return self.client.completions.create(prompt=prompt, top_p=s.top_p, **limits).choices[0].text
        return self.client.chat.completions.create(messages=told + said, top_p=s.top_p, **limits).choices[0].message.content


def _grouped(texts: Sequence[str], n: int) -> list[list[str]]:
    return [list(texts[i : i + n]) for i in range(0, len(texts), n)]
