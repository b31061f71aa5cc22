"""Refusals with the exit codes of the command line."""

from __future__ import annotations


class Refusal(Exception):
    exit_code = 1


class InputUnusable(Refusal):
    exit_code = 2


class NotEnoughFrames(Refusal):
    exit_code = 3


class PackageBroken(Refusal):
    exit_code = 4


class ResultIncomplete(Refusal):
    exit_code = 5


class ResultEmpty(Refusal):
    exit_code = 6


class MissingOrForeign(Refusal):
    exit_code = 7


class AlreadyThere(Refusal):
    exit_code = 8


class ConditionsDiffer(Refusal):
    exit_code = 9
