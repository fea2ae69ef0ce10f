"""Fast exact encoding with a public tokenizer inside Python workers.

Texts are cut at their spaces, a batch at a time, and each distinct piece is looked at once. The pieces are such that the
tokenizer's own word splitting never looks across them: texts in which a space touches other white space are encoded whole. A
piece of plain Latin letters, perhaps with punctuation after it, or two such with a line end between them, is cut into its words,
as the tokenizer's splitting would do. Each word, or other piece, is encoded once for a worker and kept in a bounded table, so
that frequent ones cost a lookup. Plain words are sent straight to the tokenizer's merge model, many in one call; other pieces
go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: Bytes that a worker's two tables of known words may take: once the younger has half of them it becomes the older one, from
#: which words still met are taken over. A word takes WORD_BYTES and its letters and ids; longer ones than LONGEST_KEPT are not kept.
MOST_BYTES, WORD_BYTES, LONGEST_KEPT = 96 << 20, 180, 256
#: How many new words are sent to the merge model in one call.
AT_ONCE = 1024
#: Letters, and the ASCII punctuation after them, but for the apostrophe, which begins contractions.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]+"
_PLAIN = rf"\A{_LETTERS}(?:{_MARKS})?(?:\n{_LETTERS}(?:{_MARKS})?)?\z"
#: In a vocabulary with spaces, a word's key in the tables has a line end in front of it where the text has no space there.
_PLAIN_KEY = rf"\A\n?(?:{_LETTERS}|{_MARKS})\z|\A\n\n\z"


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _strings(column: pa.Array) -> list[str]:
    """A column as Python strings, without a scalar for each."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """ids(text) as little-endian unsigned 32-bit bytes, equal to the tokenizer's encode(text, add_special_tokens=False).

    special_as_text: names of special tokens in a text are encoded like other text (the tokenizer's encode_special_tokens);
    otherwise, which is the tokenizer's default, they become the special tokens, and texts that hold one are encoded whole.

    spaced: the vocabulary has tokens that begin with a space, and a piece takes the space before it; otherwise white
    space is dropped, letters are folded to lower case, and a word's last token has the model's suffix."""

    def __init__(self, path: str, spaced: bool, most_bytes: int = MOST_BYTES, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        added = [t.content for t in self.whole.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        # the merge model alone, on words with blanks between them that are already in the letters that stand for bytes
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        self.spaced, self.most_bytes, self.letters = spaced, most_bytes, _byte_letters()
        # tokens that begin with a space, or that end a word
        vocabulary, suffix = self.whole.get_vocab(), self.whole.model.end_of_word_suffix
        self.limits = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.limits[[i for t, i in vocabulary.items() if (t.startswith(self.letters[32]) if spaced else suffix and t.endswith(suffix))]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _encode_plain(self, keys: list[str]) -> list[bytes]:
        """The ids of plain words, by their keys."""
        out, letters, space = [], self.letters, self.letters[32]
        words = [w if w.isascii() else w.encode().decode("latin-1").translate(letters) for w in keys]
        skipped = np.zeros(len(words), np.int64)
        if self.spaced:
            # a space alone stands before words without one, to tell them apart; it is taken off again
            bare = [w[0] in ("\n", letters[10]) for w in words]
            words = [f"{space} {w[1:]}" if b else space + w for w, b in zip(words, bare)]
            skipped[bare] = 1
        words = [w.replace("\n", letters[10]) if "\n" in w else w for w in words]
        for at in range(0, len(words), AT_ONCE):
            part, skip = words[at : at + AT_ONCE], skipped[at : at + AT_ONCE]
            [coded] = self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(coded.ids, "<u4")
            limits = np.flatnonzero(self.limits[ids])
            if len(limits) == len(part):
                begins, ends = (limits, np.append(limits[1:], len(ids))) if self.spaced else (np.append(0, limits[:-1] + 1), limits + 1)
                data = ids.tobytes()
                out += [data[i:j] for i, j in zip((4 * (begins + skip)).tolist(), (4 * ends).tolist())]
            else:
                # a vocabulary whose tokens do not tell words apart
                out += [self._packed(e.ids[k:]) for k, e in zip(skip.tolist(), self.words.encode_batch_fast(part, add_special_tokens=False))]
        return out

    def _learn(self, keys: list[str]) -> list[bytes]:
        """The ids of new words and pieces, by their keys."""
        is_plain = pc.match_substring_regex(pa.array(keys, pa.large_string()), _PLAIN_KEY).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(keys)
        plain, odd = np.flatnonzero(is_plain).tolist(), np.flatnonzero(~is_plain).tolist()
        for i, ids in zip(plain, self._encode_plain([keys[i] for i in plain])):
            out[i] = ids
        texts = [keys[i] if not self.spaced else keys[i][1:] if keys[i][0] == "\n" else f" {keys[i]}" for i in odd]
        for i, ids in zip(odd, self._encode_whole(texts)):
            out[i] = ids
        return out

    def _ids(self, keys: list[str]) -> list[bytes]:
        """The ids of words and pieces, by their keys: from the tables, or anew."""
        found = list(map(self.known.get, keys))
        at = [k for k, ids in enumerate(found) if ids is None]
        missing = [keys[k] for k in at]
        ids = list(map(self.older.get, missing)) if self.older else [None] * len(missing)
        new = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(new, self._learn([missing[k] for k in new]) if new else []):
            ids[k] = x
        for k, x in zip(at, ids):
            found[k] = x
        self._keep(missing, ids)
        return found

    def _keep(self, keys: list[str], ids: list[bytes]) -> None:
        if max(map(len, keys), default=0) > LONGEST_KEPT:
            short = [k for k, key in enumerate(keys) if len(key) <= LONGEST_KEPT]
            keys, ids = [keys[k] for k in short], [ids[k] for k in short]
        self.known.update(zip(keys, ids))
        self.held += WORD_BYTES * len(keys) + sum(map(len, keys)) + sum(map(len, ids))

    def _keys(self, found: pa.Array, n_first: int) -> tuple[pa.Array, np.ndarray]:
        """(keys of each piece, with blanks between them; pieces whose texts must be encoded whole: those that hold an added token, or at
        whose ends white space touches a space). The last n_first pieces begin texts and have no space before them."""
        plain = pc.match_substring_regex(found, _PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        whole, n_inside = np.zeros(len(found), bool), len(found) - n_first
        odd = np.flatnonzero(~is_plain)
        for i, piece in zip(odd.tolist(), _strings(found.filter(pc.invert(plain)))):
            at_space = self.spaced and (piece[-1:].isspace() or (i < n_inside and (not piece or piece[0].isspace())))
            whole[i] = at_space or bool(self.added and self.added.search(piece))
        if self.spaced:
            cut = pc.replace_substring_regex(pc.replace_substring(found, "\n", " \n\n \n"), rf"({_MARKS})", " \n\\1")
        else:
            cut = pc.replace_substring_regex(pc.utf8_lower(found), rf"({_MARKS})", r" \1")
        keys = pc.if_else(pa.array(whole), "", pc.if_else(plain, cut, found))
        if n_first:
            first = pc.binary_join_element_wise(pa.scalar("\n", keys.type), keys.slice(n_inside), pa.scalar("", keys.type))
            keys = pa.concat_arrays([keys.slice(0, n_inside), first])
        return keys, whole

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text; a null among an Arrow column's is empty."""
        if self.held > self.most_bytes // 2:
            self.known, self.older, self.held = {}, self.known, 0
        if not self.known:
            # the keys of pieces without a letter
            self.known.update({"": b"", "\n": b""} if self.spaced else {"": b""})
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        if not len(column):
            return []
        cut = pc.split_pattern(column, " ") if self.spaced else pc.ascii_split_whitespace(column)
        begins = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        codes, found, first = coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.empty(0, np.int64)
        if self.spaced:
            # pieces that stand only at a text's begin need no key with a space before them
            first, nth = np.unique(codes[begins[:-1]], return_inverse=True)
            codes[begins[:-1]] = len(found) + nth
            inside = np.zeros(len(found) + len(first), bool)
            inside[codes] = True
            found = pa.concat_arrays([pc.if_else(pa.array(inside[: len(found)]), found, ""), found.take(pa.array(first))])
        keys, whole = self._keys(found, len(first))
        lists = pc.split_pattern(keys, " ")
        words = lists.flatten().dictionary_encode()
        ids = pa.array(self._ids(_strings(words.dictionary)), pa.large_binary())
        kind = pa.LargeListArray if pa.types.is_large_list(lists.type) else pa.ListArray
        rows = kind.from_arrays(lists.offsets, words.indices).take(pa.array(codes))
        joined = ids.take(rows.flatten())
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[rows.offsets.to_numpy()[begins]].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        out = [bytes(data[i:j]) for i, j in zip(ends, ends[1:])]
        odd = np.unique(np.searchsorted(begins, np.flatnonzero(whole[codes]), side="right") - 1).tolist()
        for i, x in zip(odd, self._encode_whole([column[i].as_py() for i in odd])):
            out[i] = x
        return out


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder for a vocabulary file, special tokens as the tokenizer has them by default."""
    return kept(("encoder", path, spaced), lambda: Encoder(path, spaced, special_as_text=False))


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is on this machine; called in the tasks, since each machine has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)
