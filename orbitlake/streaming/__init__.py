"""Analyses of frames that arrive one after another."""
